"""URL filtering by pattern rules that are indexed by their rarest literal token.

Rules come from a table of (name, verdict, kind, pattern); kinds are ``host`` (host and path prefix), ``word``, ``glob`` (with
``*`` for anything) and ``regex``. The literal tokens that every URL which a rule fits must hold are read off the parsed
expression: runs of letters and digits that are closed on both sides. How often a token occurs is counted over all distinct
URLs; each rule is filed under its rarest token. The tokens of a URL then fetch its candidate rules with an equality join,
and only those run their expressions. A rule without such a token can't be filed and is tried on every distinct URL, in
place and without a join.

Host rules see the host and the path as they are; the other kinds, which are the method's own, see both in lower case.
Precedence: the longest host rule that fits decides; where none fits, the first pattern rule that fits does, and "allow"
otherwise. Each distinct URL is judged once and the verdict joined back, so a hot URL costs no more than another.

Edge cases: a null URL, or one without ``://``, has an empty host and path, fits no rule that needs a character and is
allowed; an empty rule set allows everything; tables without rows give none; repeated rows are judged alike; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Letters and digits; everything else separates tokens.
TOKEN_GAP = "[^a-z0-9]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``name`` as reported; ``pattern`` is matched against ``host + path``, with ``literals`` its necessary tokens."""

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    base: bool


def host_rule(verdict: str, rule: str) -> Rule:
    """``example.com/de/``: the host or a subdomain of it, and a path that starts with what follows the host.

    Path literals count as tokens only where the rule's own text closes them, as the URL's token may go on.
    """
    host, slash, path = rule.partition("/")
    whole = [t for t in re.split(TOKEN_GAP, host.lower()) if t]
    if re.search("[^A-Za-z0-9]$", path):
        whole += [t for t in re.split(TOKEN_GAP, path.lower()) if t]
    return Rule(rule, verdict, f"^(?:[^/]*\\.)?{re.escape(host.lower())}{re.escape(slash + path)}", tuple(whole), True)


_CLOSED, _OPEN = object(), object()


def _items(parsed) -> list:
    """A parsed expression as characters, _CLOSED where a token surely ends, and _OPEN where anything may stand."""
    out: list = []
    for op, arg in parsed:
        kind = str(op)
        if kind == "LITERAL":
            out.append(chr(arg))
        elif kind == "AT":
            out.append(_CLOSED if str(arg) in ("AT_BEGINNING", "AT_END", "AT_BEGINNING_STRING", "AT_END_STRING", "AT_BOUNDARY") else _OPEN)
        elif kind == "IN":
            out.append(_CLOSED if _separates(arg) else _OPEN)
        elif kind == "SUBPATTERN":
            out += _items(arg[3])
        elif kind == "BRANCH":
            sides = [_items(side) for side in arg[1]]
            out.append(_CLOSED if all(side == [_CLOSED] or (len(side) == 1 and isinstance(side[0], str) and not _token(side[0])) for side in sides) else _OPEN)
        elif kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
            out += [*_items(arg[2]), _OPEN]
        else:
            out.append(_OPEN)
    return out


def _token(c: str) -> bool:
    return c.isascii() and c.isalnum()


def _separates(members: list) -> bool:
    """Whether a class of characters holds no lower-case letter and no digit."""
    pattern = re._compiler.compile(re._parser.SubPattern(re._parser.State(), [(re._constants.IN, members)]))
    return not any(pattern.match(chr(c)) for c in (*range(48, 58), *range(97, 123)))


def literals(pattern: str) -> tuple[str, ...]:
    """Tokens that every text which an expression matches holds as whole ones; those of lower-case expressions."""
    found, token, closed = [], "", False
    for item in [_OPEN, *_items(re._parser.parse(pattern)), _OPEN]:
        if isinstance(item, str) and _token(item):
            token += item
            continue
        ends = item is _CLOSED or isinstance(item, str)
        if token and closed and ends:
            found.append(token.lower())
        token, closed = "", ends
    return tuple(dict.fromkeys(found))


def rule(name: str, verdict: str, kind: str, pattern: str) -> Rule:
    """A rule of a table of them."""
    if kind == "host":
        return host_rule(verdict, pattern)
    own = pattern.translate(str.maketrans(_UPPER, _LOWER)) if kind != "regex" else pattern
    made = {
        # between characters other than letters and digits
        "word": lambda: f"(?:^|[^a-z0-9]){re.escape(own)}(?:[^a-z0-9]|$)",
        "glob": lambda: "(?s)^" + ".*".join(map(re.escape, own.split("*"))) + "$",
        "regex": lambda: own,
    }[kind]()
    return Rule(name, verdict, made, literals(made.removeprefix("(?s)")), False)


def rules_of(rows: Iterable[tuple[str, str, str, str]]) -> list[Rule]:
    """The rules of (name, verdict, kind, pattern); a rule set is configuration, which the driver holds."""
    return [rule(*row) for row in rows]


#: name, verdict, kind, pattern
BASE_TABLE = [("net/", "block", "host", "net/"), ("example.net/en/", "allow", "host", "example.net/en/"), ("example.com/de/", "block", "host", "example.com/de/"), ("org/fr/", "allow", "host", "org/fr/")]
PATTERN_TABLE = [(w, "block", "word", w) for w in ("spam-farm", "cheap-pills", "casino", "click-bait", "link-farm", "free-money", "adult-cam", "warez", "phishing")] + [
    ("login page", "block", "glob", "*/wp-login.php*"),
    ("scripts", "block", "glob", "*/cgi-bin/*"),
    ("ad server", "block", "regex", r"^(?:ads?|banner|track(?:er|ing)?)[0-9]*[.]"),
    ("banner", "block", "regex", r"/(?:ads|banners)/[0-9]+x[0-9]+/"),
    ("betting", "block", "regex", r"(?:^|[^a-z0-9])(?:poker|betting)(?:[^a-z0-9]|$)"),
]
BASE_RULES, PATTERN_RULES = rules_of(BASE_TABLE), rules_of(PATTERN_TABLE)
RULES = BASE_RULES + PATTERN_RULES


def judge(pages: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and ``pattern``, the first pattern rule that fits where no base rule does."""
    spark = pages.sparkSession
    slim = common.narrow(pages, "page_id", "url").withColumn("key", F.coalesce(F.col("url").cast("string"), F.lit("")))
    rest = F.when(F.instr("key", "://") > 0, F.expr("substring(key, instr(key, '://') + 3)")).otherwise("")
    parts = slim.select("key").distinct().select("key", F.regexp_extract(rest, "^[^/?#]*", 0).alias("raw"), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1).alias("path"))
    urls = parts.select("key", "path", F.translate("raw", _UPPER, _LOWER).alias("host"))
    text = F.concat("host", "path")
    seen = urls.select("key", text.alias("text"), F.translate(text, _UPPER, _LOWER).alias("low"))
    tokens = seen.select("key", "text", "low", F.explode(F.array_distinct(F.split("low", TOKEN_GAP))).alias("token")).where("token != ''")

    shape = "id int, rule string, verdict string, pattern string, literals array<string>, base boolean"
    listed = spark.createDataFrame([(k, r.name, r.verdict, r.pattern, list(r.literals), r.base) for k, r in enumerate(rules) if r.literals], shape)
    filed = listed.select("id", F.explode("literals").alias("token"))
    # Only tokens that some rule names are counted: the join drops the others before anything is shuffled.
    counts = tokens.join(filed.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = filed.join(counts, "token", "left").groupBy("id").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    index = listed.join(rarest, "id").select("id", "token", "rule", "verdict", "pattern", "base")

    found = ["key", "id", "rule", "verdict", "base"]
    hits = tokens.join(index, "token").where(F.expr("if(base, text, low) rlike pattern")).select(*found)
    bare = [(k, r) for k, r in enumerate(rules) if not r.literals]
    if bare:
        told = lambda k, r: F.struct(F.lit(k).alias("id"), F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.base).alias("base"))
        each = F.array_compact(F.array(*(F.when(F.col("text" if r.base else "low").rlike(r.pattern), told(k, r)) for k, r in bare)))
        hits = hits.union(seen.select("key", F.explode(each).alias("r")).select("key", "r.*"))
    best = hits.groupBy("key").agg(
        F.max_by(F.struct("rule", "verdict"), F.when(F.col("base"), F.struct(F.length("rule"), -F.col("id")))).alias("best"),
        F.min_by(F.struct("rule", "verdict"), F.when(~F.col("base"), F.col("id"))).alias("pattern"),
        F.max("base").alias("based"),
    )
    judged = urls.join(best, "key", "left").select(
        "key", "host", "path",
        F.when(F.col("based"), F.col("best.rule")).alias("rule"),
        F.when(F.col("based"), F.col("best.verdict")).when(F.col("pattern").isNotNull(), F.col("pattern.verdict")).otherwise("allow").alias("verdict"),
        F.when(~F.coalesce("based", F.lit(False)), F.col("pattern.rule")).alias("pattern"),
    )
    return slim.join(judged, "key").select("page_id", "host", "path", "rule", "verdict", "pattern")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"))


def oracle() -> str:
    """The same verdicts as DuckDB SQL, rule by rule and without an index."""
    low = f"translate(host || path, '{_UPPER}', '{_LOWER}')"
    fits = lambda r: f"regexp_matches({'host || path' if r.base else low}, '{r.pattern}')"
    base = sorted((r for r in RULES if r.base), key=lambda r: -len(r.name))
    own = [r for r in RULES if not r.base]
    case = lambda what, rest: "CASE " + " ".join(f"WHEN {fits(r)} THEN {what(r)}" for r in base) + f" ELSE {rest} END"
    first = lambda what: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{what(r)}'" for r in own) + " END"
    return f"""
WITH raw AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM raw
), judged AS (
  SELECT *, {case(lambda r: f"'{r.name}'", "CAST(NULL AS VARCHAR)")} AS rule, {first(lambda r: r.name)} AS word, {first(lambda r: r.verdict)} AS told FROM parts
)
SELECT page_id, host, path, rule, {case(lambda r: f"'{r.verdict}'", "coalesce(told, 'allow')")} AS verdict,
       CASE WHEN rule IS NULL THEN word END AS pattern
FROM judged"""
