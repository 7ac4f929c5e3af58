"""Validation by a document type: its declarations as a table of models, held against a table of nodes by joins.

A DTD is a fixed, small text. On the driver its parameter entities are expanded and
each declaration becomes a row: a content model as a regular expression over the
names of the children, and the attributes that must be there. Chapters are checked
in DataFrame operations: each element's children are joined, in order, to one string
that its model must match.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COMMENT = re.compile(r"<!--.*?-->", re.S)
_ENTITY = re.compile(r"""<!ENTITY\s+%\s+([\w.:-]+)\s+(?:"([^"]*)"|'([^']*)')\s*>""")
_SECTION = re.compile(r"<!\[\s*(INCLUDE|IGNORE)\s*\[((?:(?!<!\[).)*?)\]\]>", re.S)
_ELEMENT = re.compile(r"<!ELEMENT\s+([\w.:-]+|\([^)]*\))\s+(?:[-O]\s+[-O]\s+)?([^>]+)>")
_ATTLIST = re.compile(r"""<!ATTLIST\s+([\w.:-]+)\s+((?:[^>"']|"[^"]*"|'[^']*')*)>""")
_ATTRIBUTE = re.compile(r"""([\w.:-]+)\s+(\([^)]*\)|NOTATION\s*\([^)]*\)|[A-Z]+)\s+(#REQUIRED|#IMPLIED|(?:#FIXED\s+)?(?:"[^"]*"|'[^']*'))""")
_TOKEN = re.compile(r"#PCDATA|[\w.:-]+|[()|,?*+&]")
#: Rounds in which entities may name further entities.
DEEPEST = 64


def expanded(text: str) -> str:
    """The declarations with parameter entities and conditional sections resolved; the first declaration of an entity counts."""
    bare = _COMMENT.sub(" ", text)
    known: dict[str, str] = {}
    for name, double, single in _ENTITY.findall(bare):
        known.setdefault(name, double or single)
    out = _ENTITY.sub(" ", bare)
    for _ in range(DEEPEST):
        after = re.sub(r"%([\w.:-]+);", lambda m: f" {known.get(m[1], '')} ", out)
        after = _SECTION.sub(lambda m: m[2] if m[1] == "INCLUDE" else " ", after)
        if after == out:
            break
        out = after
    return out


def model_pattern(model: str) -> tuple[str, bool]:
    """A content model as a pattern over ``name,`` for each child, and whether it may hold text."""
    model = model.strip()
    if model.startswith("EMPTY"):
        return "", False
    if model.startswith("ANY"):
        return "(?:[^,]*,)*", True
    out = []
    for token in _TOKEN.findall(model):
        if token == "#PCDATA":
            out.append("(?:)")
        elif token in "(":
            out.append("(?:")
        elif token in ")|?*+":
            out.append(token)
        elif token not in ",&":
            out.append(f"(?:{re.escape(token)},)")
    return "".join(out), "#PCDATA" in model


def declarations(text: str) -> list[tuple[str, str, bool, list[str]]]:
    """(element, pattern of its children, may hold text, required attributes) of every declared element."""
    bare = expanded(text)
    required: dict[str, list[str]] = {}
    for element, body in _ATTLIST.findall(bare):
        required.setdefault(element, []).extend(name for name, _, default in _ATTRIBUTE.findall(body) if default == "#REQUIRED")
    out = {}
    for names, model in _ELEMENT.findall(bare):
        for name in re.findall(r"[\w.:-]+", names):
            out.setdefault(name, (name, *model_pattern(model), sorted(set(required.get(name, [])))))
    return list(out.values())


def models(spark: SparkSession, text: str) -> DataFrame:
    """``(tag, pattern, mixed, required)``: one row for each element of a DTD, some hundreds at most."""
    return spark.createDataFrame(declarations(text), "tag string, pattern string, mixed boolean, required array<string>")


def dtd_errors(nodes: DataFrame, table: DataFrame, key: str = "chapter") -> DataFrame:
    """Error rows ``(key, path, error_type, error_description, severity)`` of a node table against a table of models.

    Undeclared elements, children that do not match the model, text where none may
    stand, missing attributes, and links to ids that the chapter lacks.
    """
    kids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "tag"))), lambda x: F.concat(x["tag"], F.lit(","))), "")
    inner = nodes.filter("parent_id IS NOT NULL").groupBy(F.col(key).alias("__k"), F.col("parent_id").alias("__n")).agg(kids.alias("kids"), F.max(F.col("tail") != "").alias("tails"))
    joined = nodes.join(inner, F.col(key).eqNullSafe(F.col("__k")) & (F.col("node_id") == F.col("__n")), "left").join(F.broadcast(table), "tag", "left")
    has_text = (F.col("text") != "") | F.coalesce("tails", F.lit(False))
    row = lambda kind, text: F.struct(F.lit(kind).alias("error_type"), text.alias("error_description"))
    missing = F.transform(F.filter(F.coalesce("required", F.array().cast("array<string>")), lambda a: ~F.array_contains(F.map_keys("attrs"), a)), lambda a: row("Missing Attribute", F.concat_ws(" ", F.col("tag"), F.lit("lacks"), a)))
    declared = F.col("pattern").isNotNull()
    children = F.coalesce("kids", F.lit(""))
    found = F.concat(
        F.when(~declared, F.array(row("Undeclared Element", F.col("tag")))).otherwise(F.array().cast("array<struct<error_type:string,error_description:string>>")),
        F.when(declared & ~F.regexp_like(children, F.concat(F.lit("^(?:"), F.col("pattern"), F.lit(")$"))), F.array(row("Invalid Content Model", F.concat_ws(": ", F.col("tag"), F.rtrim(F.replace(children, F.lit(","), F.lit(" "))))))).otherwise(F.array().cast("array<struct<error_type:string,error_description:string>>")),
        F.when(declared & ~F.col("mixed") & has_text, F.array(row("Text Not Allowed", F.col("tag")))).otherwise(F.array().cast("array<struct<error_type:string,error_description:string>>")),
        missing,
    )
    errors = joined.select(key, "path", F.explode(found).alias("e")).select(key, "path", "e.*", F.lit("Error").alias("severity"))
    ids = nodes.select(F.col(key).alias("__k"), F.col("attrs")["id"].alias("__id")).filter("__id IS NOT NULL")
    links = nodes.select(key, "path", F.col("attrs")["linkend"].alias("__to")).filter("__to IS NOT NULL")
    broken = links.join(ids, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__to") == F.col("__id")), "left_anti")
    return errors.unionByName(broken.select(key, "path", F.lit("Broken Link").alias("error_type"), F.col("__to").alias("error_description"), F.lit("Error").alias("severity")))
