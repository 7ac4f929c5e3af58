"""Personal data: candidate spans judged by boosted trees, in DataFrame operations only.

High-recall generators propose spans, which may overlap, of twelve kinds. Those of
the four base kinds that pass their format checks are always selected. Every
other candidate gets a score from boosted trees over format and context features.
Isotonic regression on texts held out from the fitting turns scores of a kind into
probabilities, and the score from which they reach ``PROBABILITY`` selects. The trees
are fitted on the driver on a bounded set of synthetic texts (``TRAINING_TEXTS``
of them, whatever the size of the corpus), labelled by how they were made, whose
features come from the very same expressions, and are applied as one ``CASE`` sum.
"""

from __future__ import annotations

import random
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .native import ascii_lower, indexes, let

_MARK = r" ?[\[({{] ?{} ?[\])}}] ?"
#: Generator patterns; each is linear in the text (possessive runs, bounded repeats).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "at_dot_email": rf"(?i)(?<![a-z0-9._-])[a-z0-9._-]{{1,64}}+(?:{_MARK.format('at')}| at | ?@ | @)[a-z0-9-]{{1,63}}+(?:(?:{_MARK.format('dot')}| dot | ?[.] ?)[a-z0-9-]{{2,63}}+){{1,3}}+",
    "local_phone": r"(?<![0-9+(.-])(?<![0-9] )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----|(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+={0,2}+",
    "birth_date": r"(?<![0-9./-])(?:[0-9]{1,2}([./-])[0-9]{1,2}\1(?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9/-])",
    "address": r"(?<![0-9A-Za-z])[0-9]{1,5}[a-z]? (?:[A-Z][a-z]{1,20}+ ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Way|Court|Ct|Place|Pl)(?![a-z])",
    "ipv6": r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}:{1,2}[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}(?![0-9A-Za-z:])",
}
#: What a text must hold for a generator to be tried.
QUICK = {
    "email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]", "at_dot_email": r"(?i)[\[({] ?(?:at|dot) ?[\])}]|@|(?<= )dot ",
    "local_phone": "[0-9][ .-][0-9]{4}", "ssn": "[0-9]-[0-9]{2}-[0-9]", "iban": "[A-Z]{2}[0-9]{2}",
    "secret": "[0-9][A-Za-z0-9+/_-]{7}|[A-Za-z0-9+/_-]{7}[0-9]|-----BEGIN", "birth_date": "[0-9][./-](?:19|20)?[0-9]{2}", "address": "[0-9][a-z]? [A-Z][a-z]+ [A-Z]", "ipv6": "[0-9A-Fa-f]:",
}
KINDS = list(PATTERNS)
BASE = KINDS[:4]
CUES = {
    "email": "mail|contact", "ip": r"\bip\b|address|host|server", "card": "card|visa|credit|payment", "phone": "phone|tel|call|fax|mobile",
    "at_dot_email": "mail|contact|write|reach", "local_phone": "phone|tel|call|fax|mobile", "ssn": "ssn|social", "iban": "iban|bank|account",
    "secret": "token|secret|passw|pwd|api.?key|access.?key|private.?key|auth[ _=:-]|bearer|credential", "birth_date": "born|birth|dob|geboren|geburt|nacid|nacim|n[eé]e? le|naiss",
    "address": "address|lives? |living|resid|located|ship to|deliver", "ipv6": r"\bip|address|host|server|peer",
}
COUNTER_CUES = r"\b(?:version|section|chapter|order|item|part|invoice|serial|build|page|score|isbn|figure|commit|checksum|sha-?[0-9]*|md5|hash|digest|published|updated|film|song|time|ratio|id|no\.)(?![a-z])|#"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
LEFT, RIGHT = 40, 20
TRAINING_TEXTS, TREES, DEPTH, RATE, SEED = 4000, 30, 3, 0.3, 7
#: Calibrated probability of personal data from which a candidate is selected.
PROBABILITY = 0.9
FEATURES = ["kind", "valid", "length", "digits", "distinct", "letters", "cue", "counter_cue", "assigned", "joined_left", "joined_right"]


def _prefix_sums(lengths: Column) -> Column:
    """Sum of all entries before each one, by blocks of about the root of the array's size."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def spread(values: Column, b: Column) -> Column:
        blocks = F.transform(indexes(F.ceil(F.size(values) / b).cast("int")), lambda j: total(F.slice(values, j * b + 1, b)))
        return let(blocks, lambda s: F.transform(indexes(F.size(values)), lambda i: total(F.slice(s, F.lit(1), (i / b).cast("int"))) + total(F.slice(values, (i / b).cast("int") * b + 1, i % b))))

    return let(lengths, lambda v: spread(v, F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int"))))


def _luhn(digits: Column) -> Column:
    def total(back: Column) -> Column:
        def digit(i: Column) -> Column:
            d = F.ascii(F.substring(back, i + 1, F.lit(1))) - 48
            return F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

        return F.aggregate(indexes(F.length(back)), F.lit(0), lambda a, i: a + digit(i))

    return let(F.reverse(digits), total) % 10 == 0


def _mod97(iban: Column) -> Column:
    turned = F.concat(F.substring(iban, 5, 60), F.substring(iban, 1, 4))

    def step(a: Column, c: Column) -> Column:
        return F.when(c >= 65, (a * 100 + c - 55) % 97).otherwise((a * 10 + c - 48) % 97)

    return let(turned, lambda t: F.aggregate(indexes(F.length(t)), F.lit(0), lambda a, i: step(a, F.ascii(F.substring(t, i + 1, F.lit(1)))))) == 1


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    return {
        "email": F.lit(True),
        "ip": match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        "card": (n >= 14) & (n <= 19) & _luhn(digits),
        "phone": (n >= 10) & (n <= 15),
        "at_dot_email": match.rlike(r"(?i)[\[({] ?(?:at|dot)"),
        "local_phone": match.rlike(r"^\(?[2-9][0-9]{2}\)?[ .-]*[2-9]"),
        "ssn": ~match.rlike("^(?:000|666|9)") & ~match.rlike("-00-|-0000$"),
        "iban": _mod97(F.replace(match, F.lit(" "), F.lit(""))),
        "secret": match.rlike("^(?:[0-9a-f]+|[0-9A-F]+|.*[a-z].*[A-Z].*|.*[A-Z].*[a-z].*)$") & ~match.rlike("[/_-].*[/_-]"),
        "birth_date": match.rlike("^(?:0?[1-9]|[12][0-9]|3[01])[./-](?:0?[1-9]|[12][0-9]|3[01])[./-]|-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])$"),
        "address": ~match.rlike("^0"),
        "ipv6": match.rlike("::|^(?:[0-9A-Fa-f]+:){7}[0-9A-Fa-f]+$"),
    }[kind]


def _candidates(text: Column, kind: str) -> Column:
    """Array of candidate structs of one kind, in order of start; positions in code points."""
    pattern = PATTERNS[kind]

    def build(gaps: Column) -> Column:
        def at(found: Column, starts: Column) -> Column:
            def one(i: Column) -> Column:
                m, before, after = F.get(found, i), F.get(gaps, i), F.get(gaps, i + 1)
                start = F.get(starts, i) + F.length(before)
                digits = F.regexp_replace(m, "[^0-9]", "")
                left = ascii_lower(F.substring(before, -LEFT, LEFT))
                return F.struct(
                    start.cast("int").alias("start"), (start + F.length(m)).cast("int").alias("end"), F.lit(KINDS.index(kind)).alias("kind"),
                    _valid(kind, m).cast("int").alias("valid"), F.length(m).alias("length"), F.length(digits).alias("digits"),
                    F.size(F.array_distinct(F.regexp_extract_all(digits, F.lit("[0-9]"), F.lit(0)))).alias("distinct"),
                    F.size(F.array_distinct(F.regexp_extract_all(m, F.lit("[A-Za-z]"), F.lit(0)))).alias("letters"),
                    left.rlike(CUES[kind]).cast("int").alias("cue"), left.rlike(COUNTER_CUES).cast("int").alias("counter_cue"),
                    before.rlike(r"""[=:]\s?["'`]?\z""").cast("int").alias("assigned"), before.rlike(r"[\p{L}\p{N}_/=-]\z").cast("int").alias("joined_left"), after.rlike(r"\A[\p{L}\p{N}_/=-]").cast("int").alias("joined_right"),
                )

            return F.transform(indexes(F.size(found)), one)

        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return let(found, lambda f: let(_prefix_sums(F.transform(f, lambda m, i: F.length(m) + F.length(F.get(gaps, i)))), lambda s: at(f, s)))

    made = let(F.split(text, pattern, -1), build)
    return F.when(text.rlike(QUICK[kind]), made)


def candidates(text: Column) -> Column:
    """All candidates of a text in one array; overlapping ones stay."""
    kind = "array<struct<start:int,end:int,kind:int," + ",".join(f"{f}:int" for f in FEATURES[1:]) + ">>"
    none = F.array().cast(kind)
    return F.concat(*(F.coalesce(_candidates(text, k).cast(kind), none) for k in KINDS))


@cache
def _candidate_column(session_id: str, text_col: str) -> Column:
    """Built once for a session: some thousand calls to the JVM."""
    return candidates(F.coalesce(F.col(text_col), F.lit("")))


def training_texts(n: int = TRAINING_TEXTS, seed: int = SEED) -> list[tuple[str, int]]:
    """Synthetic texts with one span each and whether that is personal data or a secret."""
    rng = random.Random(seed)
    pick = lambda k, of="0123456789": "".join(rng.choice(of) for _ in range(k))
    filler = "the report of this plan was read and sent by them when we met dans une der und con los".split()
    words = lambda k: " ".join(rng.choice(filler) for _ in range(k))
    letters = "abcdefghijklmnopqrstuvwxyz"
    hexes, mixed = "0123456789abcdef", letters + letters.upper() + "0123456789"
    named = lambda: rng.choice(letters).upper() + pick(rng.randint(3, 8), letters)
    street = lambda: f"{rng.randint(1, 9999)} {' '.join(named() for _ in range(rng.randint(1, 2)))} {rng.choice(['Street', 'St', 'Avenue', 'Road', 'Lane', 'Drive', 'Way', 'Court'])}"

    def luhn(good: bool) -> str:
        body = pick(15)
        total = sum(d if i % 2 else (2 * d - 9 * (d > 4)) for i, d in enumerate(map(int, body)))
        check = -total % 10
        return body + str(check if good else (check + rng.randint(1, 9)) % 10)

    def iban(good: bool) -> str:
        body = pick(18)
        check = 98 - int(body + "131400") % 97
        return f"DE{check if good else (check + rng.randint(1, 60)) % 97:02d}{body}"

    def key() -> str:
        return rng.choice([lambda: pick(rng.choice([32, 40, 64]), hexes), lambda: "A1" + pick(rng.randint(18, 40), mixed), lambda: "b7" + pick(rng.randint(20, 44), mixed + "+/") + "="])()

    def six() -> str:
        groups = [pick(rng.randint(1, 4), hexes) for _ in range(8)]
        return ":".join(groups) if rng.random() < 0.6 else ":".join(groups[:2]) + "::" + ":".join(groups[2 : rng.randint(3, 6)])

    def date() -> str:
        return rng.choice([f"{rng.randint(1, 28):02d}{{0}}{rng.randint(1, 12):02d}{{0}}{rng.randint(1930, 2015)}".format(rng.choice("./-")), f"{rng.randint(1930, 2015)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"])

    people = {
        "email": lambda: f"{rng.choice(filler)}.{pick(2)}@mail.example.org",
        "ip": lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)),
        "card": lambda: luhn(rng.random() < 0.9),
        "phone": lambda: f"+1 ({pick(3)}) 555-{pick(4)}",
        "at_dot_email": lambda: rng.choice(["{} [at] {} [dot] org", "{}[at]{}[dot]com", "{} at {} dot com", "{} (at) {} (dot) net", "{} [at] {}.org", "{} @ {}.com"]).format(rng.choice(filler) + pick(1), rng.choice(filler)),
        "local_phone": lambda: rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}"]).format("4" + pick(2), "5" + pick(2), pick(4)),
        "ssn": lambda: f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}",
        "iban": lambda: iban(rng.random() < 0.9),
        "secret": key,
        "birth_date": date,
        "address": street,
        "ipv6": six,
    }
    leads = {
        "email": ["mail: "], "ip": ["server: "], "card": ["card: ", "credit card "], "phone": ["call: ", "phone "], "at_dot_email": ["contact: ", "write to "], "local_phone": ["phone: ", "call "],
        "ssn": ["ssn: ", "social security "], "iban": ["iban: ", "bank account "], "birth_date": ["born ", "date of birth: ", "dob "], "address": ["address: ", "lives at "], "ipv6": ["host ", "ip: "],
        "secret": ['token = "', "api_key: ", "secret=", 'password: "', "bearer ", "access key ", 'auth_token="'],
    }
    cued = {"ssn": 0.9, "at_dot_email": 0.9, "local_phone": 0.9, "birth_date": 1.0, "secret": 1.0}
    others = [
        lambda: f"{rng.choice(['order', 'serial', 'invoice'])} {luhn(False)}",
        lambda: luhn(False),
        lambda: f"version {rng.randint(256, 999)}.{pick(1)}.{pick(2)}.{pick(4)}",
        lambda: f"{pick(4)}.{pick(3)}.{pick(1)}.{pick(3)}",
        lambda: f"{rng.choice(['item', 'part', 'page'])} {pick(3)}-{pick(3)}-{pick(4)}",
        lambda: f"{pick(3)} {pick(3)} {pick(4)}",
        lambda: f"{rng.choice(['order', 'item'])} {pick(3)}-{pick(2)}-{pick(4)}",
        lambda: f"{pick(3)}-{pick(2)}-{pick(4)}",
        lambda: f"{rng.choice(filler)} at {rng.choice(filler)} dot {rng.choice(filler)}",
        lambda: f"{rng.choice(filler)} at {rng.choice(filler)}. {rng.choice(filler)}",
        lambda: iban(False),
        lambda: f"serial {iban(False)}",
        lambda: f"+{pick(1)} {pick(2)}-{pick(3)}",
        lambda: f"{rng.choice(['commit ', 'sha256 ', 'md5: ', 'checksum ', 'build ', ''])}{key()}",
        lambda: f"token {rng.choice(filler)}_{rng.choice(filler)}-{rng.choice(filler)}_layer_{pick(2)}",
        lambda: f"{rng.choice(filler)}-{rng.choice(filler)}-{rng.choice(filler)}-{rng.choice(filler)}-{pick(4)}",
        lambda: f"/{rng.choice(filler)}/{rng.choice(filler)}/{pick(12, hexes)}/{rng.choice(filler)}",
        lambda: f"{rng.choice(['published ', 'updated ', 'version ', 'order of ', ''])}{date()}",
        lambda: f"{rng.choice(['chapter', 'section', 'part', 'film'])} {street()}",
        lambda: f"{rng.choice(['at ', 'time ', 'ratio ', ''])}{pick(2)}:{pick(2)}:{pick(2)}",
        lambda: f"{pick(2)}:{pick(2)}",
    ]
    out = []
    for _ in range(n):
        if rng.random() < 0.5:
            kind = rng.choice(KINDS)
            lead = rng.choice(leads[kind]) if rng.random() < cued.get(kind, 0.5) else ""
            out.append((f"{words(4)} {lead}{people[kind]()}{lead[-1] if lead[-1:] == chr(34) else ''} {words(3)}", 1))
        else:
            out.append((f"{words(4)} {rng.choice(others)()} {words(3)}", 0))
    return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> list:
    """Gradient boosting of the logistic loss with Newton leaves; a tree is a leaf value or (feature, bound, at most, above)."""
    score = np.zeros(len(y))
    model = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int):
        leaf = float(rate * g[rows].sum() / (h[rows].sum() + 1.0))
        if level == 0 or len(rows) < 20:
            return leaf
        base, best = g[rows].sum() ** 2 / (h[rows].sum() + 1.0), (1e-6, None, None)
        for f in range(x.shape[1]):
            for bound in np.unique(x[rows, f])[:-1]:
                low = x[rows, f] <= bound
                gain = sum(g[r].sum() ** 2 / (h[r].sum() + 1.0) for r in (rows[low], rows[~low])) - base
                if gain > best[0]:
                    best = (gain, f, int(bound))
        if best[1] is None:
            return leaf
        low = x[rows, best[1]] <= best[2]
        return (best[1], best[2], grow(rows[low], g, h, level - 1), grow(rows[~low], g, h, level - 1))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = grow(np.arange(len(y)), y - p, p * (1 - p), depth)
        score += predict([tree], x)
        model.append(tree)
    return model


def predict(model: list, x: np.ndarray) -> np.ndarray:
    def one(tree, rows):
        if not isinstance(tree, tuple):
            out[rows] += tree
            return
        low = x[rows, tree[0]] <= tree[1]
        one(tree[2], rows[low])
        one(tree[3], rows[~low])

    out = np.zeros(len(x))
    for tree in model:
        one(tree, np.arange(len(x)))
    return out


def calibrated(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression: distinct scores ascending and the probability of each, by pooling neighbours that fall."""
    values, at = np.unique(score, return_inverse=True)
    pools = [[float(w), float(m), 1] for w, m in zip(np.bincount(at), np.bincount(at, weights=label), strict=True)]
    done: list[list[float]] = []
    for pool in pools:
        done.append(pool)
        while len(done) > 1 and done[-2][1] * done[-1][0] >= done[-1][1] * done[-2][0]:
            last = done.pop()
            done[-1] = [x + y for x, y in zip(done[-1], last, strict=True)]
    return values, np.repeat([m / w for w, m, _ in done], [int(k) for *_, k in done])


@cache
def _fitted(rows: tuple, trees: int, depth: int) -> tuple[list, tuple]:
    """The trees from one half; the least score of each kind whose probability, calibrated on the other half, suffices."""
    table = np.array(rows, np.int64)
    x, y = table[:, :-1], table[:, -1]
    held = np.arange(len(y)) % 2 == 1
    model = fit_trees(x[~held], y[~held], trees, depth)
    score, limits = predict(model, x[held]), []
    for kind in range(len(KINDS)):
        own = x[held][:, 0] == kind
        values, p = calibrated(score[own], y[held][own]) if own.any() else (np.zeros(0), np.zeros(0))
        good = values[p >= PROBABILITY]
        limits.append(float(good[0]) - 1e-9 if len(good) else float("inf"))
    return model, tuple(limits)


@cache
def _training_rows(session_id: str, n: int, seed: int) -> tuple:
    spark = SparkSession.getActiveSession()
    made = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(training_texts(n, seed))], "i int, text string, y int")
    rows = made.select("i", "y", F.explode(_candidate_column(session_id, "text")).alias("c")).select("i", *(f"c.{f}" for f in FEATURES), "y").collect()
    return tuple(tuple(r)[1:] for r in sorted(rows))


def model(spark: SparkSession, n: int = TRAINING_TEXTS, seed: int = SEED) -> tuple[list, tuple]:
    """Trees and thresholds, the same for every session and corpus."""
    return _fitted(_training_rows(spark.sparkContext.applicationId, n, seed), TREES, DEPTH)


def _selected(trees: list, limits: tuple) -> str:
    """SQL that tells whether candidate ``c`` is selected. As text it is parsed at once, whatever the number of trees."""

    def one(tree) -> str:
        if not isinstance(tree, tuple):
            return f"{tree!r}D"
        return f"CASE WHEN c.{FEATURES[tree[0]]} <= {tree[1]} THEN {one(tree[2])} ELSE {one(tree[3])} END"

    limit = "CASE c.kind " + " ".join(f"WHEN {k} THEN {x!r}D" for k, x in enumerate(limits) if x != float("inf")) + " END"
    return f"({_BASE_SQL}) OR coalesce({' + '.join(one(t) for t in trees)} >= {limit}, false)"


_BASE_SQL = f"c.kind < {len(BASE)} AND c.valid = 1"


def spans(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``pii``, an array of (start, end, kind, base) sorted by start and kind.

    Positions are code points, ends exclusive. Spans of different kinds may
    overlap. A null text has an empty array; repeated rows each have theirs; a
    column named ``pii`` is replaced; an empty table gives an empty result.
    """
    trees, limits = model(df.sparkSession)
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    held = "__pii_candidates"
    while held in df.columns:
        held += "_"
    picked = F.expr(f"transform(filter({held}, c -> {_selected(trees, limits)}), c -> struct(c.start AS start, c.kind AS kind, c.end AS end, {_BASE_SQL} AS base))")
    named = df.withColumn(held, _candidate_column(df.sparkSession.sparkContext.applicationId, text_col)).withColumn("pii", F.array_sort(picked)).drop(held)
    return named.withColumn("pii", F.expr(f"transform(pii, c -> struct(c.start AS start, c.end AS end, element_at({names}, c.kind + 1) AS kind, c.base AS base))"))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with each selected span replaced by its kind in square brackets, e.g. ``[EMAIL]``.

    Overlapping spans become one, named after the first. Null texts stay null.
    """
    found = spans(df, text_col)
    text = F.col(text_col)

    def step(a: Column, s: Column) -> Column:
        fresh = F.struct(F.concat(a["done"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("done"), s["end"].alias("at"))
        inside = F.struct(a["done"].alias("done"), F.greatest(a["at"], s["end"]).alias("at"))
        return F.when(s["start"] < a["at"], inside).otherwise(fresh)

    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    new = F.aggregate("pii", start, step, lambda a: F.concat(a["done"], F.substring(text, a["at"] + 1, F.greatest(F.length(text) - a["at"], F.lit(0)))))
    return found.withColumn(text_col, F.when(F.size("pii") > 0, new).otherwise(text)).drop("pii")
