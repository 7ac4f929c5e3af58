"""Repair of words split by line breaks, kerning and hyphenation; lossy by nature, so it is only applied by name.

Everything is a chain of regular-expression replacements on a column, so the repair
stays inside generated code. A rule that only joins certain pieces is one pattern
with two branches: the pair to join, whose parts are put back without what stood
between them, and any other pair of that shape, which is put back whole. So each
pair is judged once, from left to right, and no piece takes part in two joins of
one round.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: endings after which a split is undone -----------------------------------------
# Pieces that follow a stray single space.
KERNED = """
c i a e o u ca ce ci co cu ga ge gi go gu re ri ro ru na ne ni no nu ta te ti to tu ba be bi bo bu la le li lo lu
ma me mi mo mu pa pe pi po pu sa se si so su ag ect cal ics ous nal ial ity ary ory ery pany nior ally nifi bral
tion sion ment ness city ical ious eous tive able ible ular lish nize ture ction ation ition ution nally tions sions
ments cally ially ually ously ively glish nition nitions nization ization izations agement agements ference ferences
brate brated brating er ers ter ters gy gies try tries nic nics nals ty ties ware ward wards ble bles bly cess cesses
cial cially tain tains tained taining tures tured turing lize lized lizing lization tives tively ence ences ance ances
ual ually ure ures cate cated cating cation cations nesses less lessly age ages aged aging ized izing ese ish dom doms
ar ars or ors ist ists ism isms ful fully ship ships hood hoods like wise ways cy cies th ths ly ry ries
""".split()
# Pieces that follow a stray hyphen.
HYPHENATED = """
tromagnetic tromagnet tronic tronics trical tric tron cluding clusion clusive clude erence erences ference ferences ation
ations ment ments tion tions sion sions agement agements ity ities ness nesses ance ances ence ences able ible ably ibly
ful fully less lessly ing ings ly ized izing ization ised ising isation ology ological ologist ular ulars ularly ulate
ulated ulating ulation ative atively atives ous ously ousness ical ically lated lating lation lations formed forming
formation pared paring paration vious viously netic netics netically dition ditional ditionally ticular ticularly cording
cordingly quent quently quence tain tained taining tains plied plying plication plications proved proving provement duced
ducing duction posed posing position vided viding vision cessed cessing cess pected pecting pection signed signing quired
quiring quirement ceived ceiving ception sented senting sentation veloped veloping velopment termine termined termining
termination
""".split()
# Characters that may stand behind a kerned piece.
BEHIND = ".,;:!?'\")d0123456789\\"
# --------------------------------------------------------------------------------------------------

#: Rounds in which kerned pieces are joined; a piece that a join has made longer may take part in the next.
ROUNDS = 5


def _any_of(pieces: list[str]) -> str:
    """Alternatives, longest first."""
    return "(?:" + "|".join(sorted(set(pieces), key=lambda x: (-len(x), x))) + ")"


def _joins() -> list[tuple[str, str]]:
    """(pattern, replacement) of every step in order. Letters, digits and white space are those of Unicode."""
    ends = r"(?=[\s.,;:!?)\]\"'\d]|$)"
    behind = "[" + "".join(rf"\x{ord(x):02x}" for x in BEHIND) + "]*"
    bare = _any_of([p for p in KERNED if p[-1] not in BEHIND])  # what is cut off behind a piece is never part of it
    kerned = rf"([A-Za-z]{{2,}}) ({_any_of(KERNED)}){ends}|([A-Za-z]{{2,}} [a-z]{{1,8}}{ends})"
    return [
        (r"(\w)-\s*\n\s*(\w)", "$1-$2"),  # a hyphen at the end of a line stays
        (r"([^\s-])\s*\n\s*([a-z])", "$1 $2"),  # a line that goes on in lower case
        (r"(\w{2,})- ([a-z]{2,})", "$1$2"),  # a hyphen and a space
        (rf"(\w+)-({_any_of(HYPHENATED)})(?![a-z])|(\w+-[a-z]{{2,}})", "$1$2$3"),  # a hyphen inside a word
        *[(kerned, "$1$2$3")] * ROUNDS,
        (rf"(?<![^ ])([^ ]*\p{{L}}) (?=\p{{Ll}})((?i:{bare}){behind})(?![^ ])", "$1$2"),  # a kerned piece with something behind it
        (r"(\w)\s{2,}(\w)", "$1$2"),  # a lost ligature
        (r"[ \t]{2,}", " "),
        (r"-\n", "-"),
        (r"(\S)\n(\S)", "$1 $2"),
    ]


def repair(text: Column) -> Column:
    """``text`` with split words joined. A text without space, line feed or inner hyphen stays as it is, as does null."""
    out = text
    for pattern, replacement in _joins():
        out = F.regexp_replace(out, "(?U)" + pattern, replacement)
    return F.when(text.rlike(r"(?U)[\n ]|\w-[a-z]"), out).otherwise(text)
