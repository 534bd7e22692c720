"""Secret scanning by multipart credential linking, in Spark's own functions.

Strong secrets (``BASE``) are reported as they are. Access identifiers, secrets and endpoints that mean little alone are
weak candidates. An interval join within each document's scopes, of ``SCOPE`` code points around a part, links them: the
bounds of all parts are sorted and two sweeps carry, for each type, the nearest part that ends before and that begins
after, which decides whether one lies within the scope, without forming pairs; time grows with a text's parts. A weak
secret is reported if an identifier or an endpoint is near, a weak identifier if a secret is near, an endpoint if both
are; parts that overlap don't complete each other. Strong secrets count as secrets (AKIA keys as identifiers) in this join.

Edge cases: a null or empty text has no spans; places count code points; texts of any length are read whole, with patterns
that neither backtrack nor recurse over them; equal places are ordered by type; repeated rows each give a row; a table
without rows gives none; a null doc_id stays null; other columns are ignored, or kept where rows are returned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import let
from .spans import apart, listed, masked, merged, of_kind, scanned, spans, touched

KINDS = ("assign", "access", "hex")
WEAK = ("identifier", "secret", "endpoint")
SCOPE = 256

_ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?+ *+[:=] *+[\"']?+([A-Za-z0-9+/_.=-]++)"
BASE = {"assign": _ASSIGN, "access": "AKIA[A-Z0-9]++", "hex": "(?<![0-9a-f])[0-9a-f]{16,}+"}
_CHEAP = {
    "assign": lambda t: t.rlike("(?i)passw|secret|token|api_?key"),
    "access": lambda t: F.contains(t, F.lit("AKIA")),
    "hex": lambda t: t.rlike("[0-9a-f]{16}"),
}
_CODED = "[A-Za-z0-9+/_-]"
#: No form has a greatest length; all runs are possessive, so that long ones are read once.
LOOSE = {
    "identifier": r"(?i:client_?id|access_?key(?:_?id)?|user_?name|account_?id|login|user)[\"']?+ *+[:=] *+[\"']?+([A-Za-z0-9@._-]{3,}+)",
    # Small and capital letters and digits together, as keys have them; the look-aheads end where the run does.
    "secret": rf"(?<!{_CODED})(?=[a-z+/_-]*+[A-Z0-9])(?=[A-Z0-9+/_-]*+[a-z])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Za-z+/_-]*+[0-9]){_CODED}{{20,}}+={{0,2}}+(?!{_CODED})",
    "endpoint": r"(?:https?|ftp|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp|s3)://[^\s\"'<>]{4,}+|(?i:host|endpoint|server|region)[\"']?+ *+[:=] *+[\"']?+[A-Za-z0-9.-]{4,}+",
}
_CHEAP_LOOSE = {
    "identifier": lambda t: t.rlike("(?i)(?:id|key|name|login|user)[\"']? *+[:=]"),
    "secret": lambda t: t.rlike(f"{_CODED}{{20}}"),
    "endpoint": lambda t: F.contains(t, F.lit("://")) | t.rlike("(?i)(?:host|endpoint|server|region)[\"']? *+[:=]"),
}
_PART = "array<struct<start:int,end:int,part:int,weak:boolean,inner:boolean>>"
_FAR = 1 << 30


def base(text: Column, kind: str) -> Column:
    """Strong secrets of a kind, with their place; an assignment needs a value of 12 characters or more."""
    if kind == "assign":
        return F.filter(spans(text, _ASSIGN, _CHEAP[kind](text), 1), lambda s: F.length(s["text"]) >= 12)
    found = spans(text, BASE[kind], _CHEAP[kind](text))
    return F.filter(found, lambda s: F.length(s["text"]) >= 18) if kind == "access" else found


def _parts(own: Column, part: int, weak: bool, inner: Column | None = None) -> Column:
    """Spans as parts; ``inner``: whether each is a piece of an endpoint."""
    made = lambda flags: F.transform(own, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(part).alias("part"), F.lit(weak).alias("weak"), (F.lit(False) if flags is None else flags[i]).alias("inner")))
    return made(None) if inner is None else let(inner, made)


def _near(parts: Column) -> Column:
    """For each of some sorted parts, struct b: the nearest end at or before its start, n: the nearest start at or after
    its end, of each type; two sweeps over the sorted bounds."""
    bound = lambda at, o, k, x: F.struct(at.alias("at"), F.lit(o).alias("o"), k.alias("k"), x["part"].alias("part"))
    bounds = F.array_sort(F.flatten(F.transform(parts, lambda x, k: F.array(bound(x["end"], 0, k, x), bound(x["start"], 1, k, x)))))
    types = range(len(WEAK))

    def swept(events: Column, o: int, none_: int, pick: Callable[..., Column]) -> Column:
        """The states at the bounds that are not of sort ``o``, by part; those of sort ``o`` change them."""
        states = F.transform(events, lambda e: F.struct(*(F.when((e["o"] == o) & (e["part"] == t), e["at"]).otherwise(F.lit(none_)).alias(f"t{t}") for t in types)))
        seen = scanned(states, lambda a, b: F.struct(*(pick(a[f"t{t}"], b[f"t{t}"]).alias(f"t{t}") for t in types)))
        asked = F.filter(F.zip_with(events, seen, lambda e, s: F.struct(e["k"].alias("k"), e["o"].alias("o"), s.alias("s"))), lambda x: x["o"] != o)
        return F.transform(F.array_sort(asked), lambda x: x["s"])

    return let(bounds, lambda e: F.arrays_zip(parts.alias("x"), swept(e, 0, -_FAR, F.greatest).alias("b"), swept(F.reverse(e), 1, _FAR, F.least).alias("n")))


def linked(parts: Column) -> Column:
    """Of an array of parts, the weak ones with complementary parts within the scope, sorted.

    Complementary parts are disjoint from the weak one: an endpoint doesn't complete a secret in itself. A secret that is
    ``inner``, a piece of some endpoint, needs an identifier.
    """
    near = lambda z, t: (z["x"]["start"] - z["b"][f"t{t}"] <= SCOPE) | (z["n"][f"t{t}"] - z["x"]["end"] <= SCOPE)

    def complete(z: Column) -> Column:
        ident, secret, endpoint = (near(z, t) for t in range(3))
        x = z["x"]
        return x["weak"] & F.when(x["part"] == 0, secret).when(x["part"] == 1, ident | (endpoint & ~x["inner"])).otherwise(ident & secret)

    return F.transform(F.filter(let(F.array_sort(parts), _near), complete), lambda z: z["x"])


def _scanned(text: Column) -> tuple[dict[str, Column], dict[str, Column]]:
    return {k: base(text, k) for k in KINDS}, {k: spans(text, LOOSE[k], _CHEAP_LOOSE[k](text)) for k in WEAK}


def _found(rows: DataFrame, text: Column, names: list[str]) -> DataFrame:
    """The columns ``names`` with text, n_assign, n_access, n_hex, base and more (spans of kind, start, end)."""
    strong, weak = _scanned(F.col("text"))
    exact = rows.select(*names, text.alias("text")).select(*names, "text", *(c.alias(f"base_{k}") for k, c in strong.items()), *(c.alias(f"loose_{k}") for k, c in weak.items()))
    every = F.concat(*(of_kind(k, F.col(f"base_{k}")) for k in KINDS))
    ordered = exact.select("*", F.transform(F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("o"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("base"))
    loose = F.concat(*(_parts(F.col(f"loose_{k}"), n, True, touched(F.col("loose_secret"), F.col("loose_endpoint")) if k == "secret" else None) for n, k in enumerate(WEAK)))
    fresh = F.when(F.size(loose) == 0, F.array().cast(_PART)).otherwise(apart(loose, F.col("base")))
    strong_parts = F.concat(_parts(F.col("base_access"), 0, False), _parts(F.concat(F.col("base_assign"), F.col("base_hex")), 1, False))
    joined = ordered.select(*names, "text", *(F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS), "base", strong_parts.alias("strong"), fresh.alias("fresh"))
    parts = joined.withColumn("parts", F.when(F.size("fresh") == 0, F.array().cast(_PART)).otherwise(F.concat("fresh", "strong")))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    more = F.when(F.size("parts") == 0, empty).otherwise(F.transform(linked(F.col("parts")), lambda s: F.struct(F.element_at(F.array(*map(F.lit, WEAK)), s["part"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return parts.select(*names, "text", *(f"n_{k}" for k in KINDS), "base", more.alias("more"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text, counts of the strong kinds, and the spans: ``base``, and ``more`` for linked weak candidates."""
    slim = common.narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _found(slim, F.coalesce(F.col("text"), F.lit("")), ["doc_id"])


def _sorted(*columns: str) -> Column:
    """All spans by start, then kind as listed, strong ones first."""
    order = F.array(*map(F.lit, KINDS + WEAK))
    keyed = F.transform(F.concat(*map(F.col, columns)), lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("o"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with their columns; each reported span of the text is replaced, and n_chars counted anew."""
    own = docs.columns
    flat = docs.toDF(*(f"_{i}" for i in range(len(own))))
    names = [f"_{i}" for i in range(len(own))]
    at = own.index("text")
    found = _found(flat, F.coalesce(F.col(f"_{at}").cast("string"), F.lit("")), names)
    gone = found.select(*names, "text", merged(_sorted("base", "more")).alias("gone"))
    cleaned = gone.select(*names, "gone", masked(F.col("text"), F.col("gone"), mark).alias("cleaned"))
    hit = F.size("gone") > 0
    new = {"text": F.when(hit, F.col("cleaned")).otherwise(F.col(f"_{at}"))}
    if "n_chars" in own:
        n = own.index("n_chars")
        new["n_chars"] = F.when(hit, F.length("cleaned").cast(flat.schema[n].dataType)).otherwise(F.col(f"_{n}"))
    first = {name: own.index(name) for name in new}
    return cleaned.select(*((new[c] if first.get(c) == i else F.col(f"_{i}")).alias(c) for i, c in enumerate(own)))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *(f"n_{k}" for k in KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(_sorted("base", "more")).alias("spans"),
        F.size("more").cast("long").alias("n_more"), (F.size("base") + F.size("more")).cast("long").alias("n_spans"),
    )
