"""Personal data by candidate gradient boosting, in Spark's own functions.

Generators of high recall propose spans of four kinds, overlapping ones too. Spans of the exact forms (``BASE``) are taken
as they are. The looser ones (``LOOSE``: obfuscated addresses, phone numbers without a country code, card-like numbers,
other ways to write network addresses) get features of their format and their context; boosted trees score them and a
threshold for each kind, calibrated on held-out candidates, selects. Spans of several kinds may be selected for one place,
and redaction covers them all; a candidate that overlaps an exact span is not needed and goes.

The trees are fitted on ``SAMPLE`` synthetic candidates, which Spark generates by rule; a third of their frames fits, another
calibrates, and the last tells precision and recall (``report``).

Edge cases: a null or empty text has no spans; places count code points, whatever the script; texts of any length are read
whole, with patterns that neither backtrack nor recurse; repeated rows each give a row; a table without rows gives none; a
null doc_id stays null; other columns are ignored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting, common
from .common import let
from .spans import apart, listed, masked, merged, of_kind, spans

KINDS = ("email", "ip", "card", "phone")
#: Synthetic candidates, those for each kind together.
SAMPLE = 6_000
PRECISION = 0.95
CONTEXT = 24

_LOCAL = "[A-Za-z0-9._%+-]"
#: Exact forms; ``\\G`` lets a match start right after another, the look-behinds let no other start within a run.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_CHEAP = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){12}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
_AT, _DOT = r"(?: ?[\[({][aA][tT][\])}] ?| [aA][tT] )", r"(?: ?[\[({][dD][oO][tT][\])}] ?| [dD][oO][tT] )"
#: Bounds on digits are those of the forms themselves; runs of letters have none.
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++{_AT}[A-Za-z0-9-]++(?:(?:{_DOT}|\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){3,7}+[0-9A-Fa-f]{1,4}|[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9]{4}([ ._/-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ ./-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
}
_CHEAP_LOOSE = {
    "email": lambda t: t.rlike(rf"{_AT}[A-Za-z0-9-]++(?:{_DOT}|\.)[A-Za-z0-9-]"),
    "ip": lambda t: t.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:|[0-9]\[\.\][0-9]"),
    "card": lambda t: t.rlike(r"[0-9]{4}[ ._/-][0-9]{4}"),
    "phone": lambda t: t.rlike(r"[0-9]{3}[ .-][0-9]{3}"),
}
_KEYWORDS = {
    "email": r"mail|contact|write|reach|send|kontakt|correo|courriel",
    "ip": r"\bip\b|host|addr|server|node|client|peer|login",
    "card": r"card|visa|amex|credit|debit|payment|karte|tarjeta|carte",
    "phone": r"phone|call|tel|mobile|cell|fax|dial|sms|whatsapp|telefon|llama",
}
_FEATURES = ("kind", "digits", "length", "separators", "keyword", "distinct", "luhn", "joined", "domain", "bracket", "groups", "counted", "worded", "letters", "low")


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def base(text: Column, kind: str) -> Column:
    found = spans(text, BASE[kind], _CHEAP[kind](text))
    return {
        "email": lambda s: s,
        "ip": lambda s: F.filter(s, lambda x: x["text"].rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2}|(?<=0))(?:\.|$)){4}$")),
        "card": lambda s: F.filter(s, lambda x: let(_digits(x["text"]), lambda d: F.length(d).between(13, 19) & F.when(F.length(d) <= 19, F.call_function("luhn_check", d)).otherwise(False))),
        "phone": lambda s: F.filter(s, lambda x: F.length(_digits(x["text"])).between(9, 15)),
    }[kind](found)


def _features(kind: str, s: Column) -> Column:
    """Format and context of a candidate, as an array of doubles in the order of ``_FEATURES``."""
    left, right = F.lower(s["left"]), s["right"]
    digits = _digits(s["text"])
    number = lambda c: c.cast("double")
    return F.array(
        F.lit(float(KINDS.index(kind))), number(F.length(digits)), number(F.length(s["text"])), number(F.length(F.regexp_replace(s["text"], "[A-Za-z0-9]", ""))),
        number(left.rlike(_KEYWORDS[kind])), number(F.size(F.array_distinct(F.split(digits, "")))), number(F.coalesce(F.when(F.length(digits).between(12, 19), F.call_function("luhn_check", digits)), F.lit(False))),
        number(left.rlike("[a-z0-9_/#-]$") | right.rlike("[A-Za-z0-9_/-]")), number(s["text"].rlike(r"(?i)[^a-z](?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$")),
        number(s["text"].rlike(r"[\[({]")), number(F.size(F.split(s["text"], "[^A-Za-z0-9]+"))), number(left.rlike(r"(?:[$€£#]|no\.?|nr\.?|id|isbn|part|order|version|v\.?|page|since|total|sum) ?:? ?$")),
        number(left.rlike("[a-z] ?$")), number(s["text"].rlike("[g-zG-Z]")), number(F.coalesce(F.get(F.split(digits, ""), F.lit(0)), F.lit("")).isin("0", "1")),
    )


def candidates(text: Column, kind: str) -> Column:
    """Loose candidates (start, end, x) of a kind."""
    found = spans(text, LOOSE[kind], _CHEAP_LOOSE[kind](text), context=CONTEXT)
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _features(kind, s).alias("x")))


#: Frames and forms of synthetic candidates, by kind and truth: @ stands for a candidate, # for a digit. The frames of a kind are
#: dealt into thirds by their place here, to fit, to calibrate and to report, so that no context is seen in two of them.
_TRUE = {
    "email": (
        ["mail me: @", "write to @ soon", "contact @", "or @ for help", "@", "my address is @", "send it to @ please", "questions? @", "reach us under @", "from: @ to all", "e-mail @ or call", "the author, @, says", "kontakt: @", "you find me at @ most days", "ask @ first"],
        ["ann.lee(at)host#(dot)com", "joe# [at] mail#.org", "x# at corp# dot net", "kim_#{at}uni#{dot}edu", "info(at)shop-##.de", "b.smith AT lab#.gov", "sales [at] my-firm# [dot] co [dot] uk", "j##[at]box.io", "tom(AT)web#(DOT)fr", "mary(at)home(dot)com", "jo.ann [at] web.org", "desk AT firm DOT net", "paul{at}mail.fr"],
    ),
    "ip": (
        ["host @ is up", "ip: @", "login from @", "the node @ failed", "seen @ twice", "client @ was blocked", "addr @ port 80", "from @ at dawn", "server=@", "ping @ now", "peer @ timed out", "route via @", "banned: @", "it answers under @", "@ is unreachable"],
        ["2001:db8:#:0:0:8a2e:370:7334", "fe80:0:0:#:1ff:fe23:4567:890a", "10[.]#[.]7[.]12", "192[.]168[.]1[.]#", "2a02:##:beef:1:2:3:4:5#", "fd00:#:#:a:b:c:d:e#", "8[.]8[.]#[.]##", "172[.]16[.]#[.]1##"],
    ),
    "card": (
        ["my card @", "visa @ exp", "credit card: @", "payment by @ today", "amex @", "charged to @ again", "it was @, valid to may", "debit @", "use @ for this", "mastercard @ cvv", "karte: @", "paid with @", "billing: @", "the number on it is @", "card ending @"],
        ["4111.1111.1111.11##", "5500/0000/0000/00##", "4012_8888_8888_18##", "4242 4242 4242 42##", "4539-5787-6362-14##", "5105.1051.0510.51##", "6011/1111/1111/11##", "4916_3385_0608_28##"],
    ),
    "phone": (
        ["call @", "tel. @", "my phone is @", "fax: @ please", "dial @ now", "at @ after six", "mobile @", "text me on @", "sms to @", "ring @ and ask", "telefon @", "hotline: @", "you can get me on @ today", "office @ or home", "whatsapp @"],
        ["(555) 01#-47##", "555-2#1-90##", "030 90#1 22##", "(212) 555.01##", "91 4#5 67##", "(0171) 22#-98##", "415.5##.26##", "020 79## 03##"],
    ),
}
_FALSE = {
    "email": (
        ["met @", "was @ in all", "look @ and", "so @", "they found @", "it ended @", "we left @", "all stood @", "none came @", "sold @ then", "he sat @", "then @ again", "she was @ for long", "trains stop @", "the light is @"],
        ["us at noon dot we went", "back at ten dot he sat#", "them at home dot no one", "it (at) best.this was", "quick at first. then slow", "good at chess.he won", "him at five dot so be it", "up at dawn dot all slept", "open (at) least.some", "seen at 1#.of those", "paid (at) 2#.the rest"],
    ),
    "ip": (
        ["time @ passed", "ratio @ of", "chapter @ says", "at @ sharp", "took @ in all", "score @", "from @ on", "verse @ reads", "mix it @", "odds of @", "started @", "lap @ of", "it was @ then", "scale @ to", "track @ plays"],
        ["12:30:4#:10", "1:2:3:#", "10:11:12:13:#", "0:0#:12:59", "23:5#:59:01", "4:3:2:1:#", "00:1#:30:12", "7:0#:15:45"],
    ),
    "card": (
        ["part no. @", "id: @", "serial @ of", "from @ to", "#@", "order @", "isbn @", "invoice no. @", "ref @ in", "version @", "years @ on", "total: @", "lot @ sold", "code @ was", "account no. @"],
        ["2019.2020.2021.2###", "0000-0000-0000-00##", "1234_5678_9012_3###", "1000 2000 3000 40##", "1990/1991/1992/19##", "0100.0200.0300.04##", "1111 2222 3333 4###", "0001_0002_0003_00##"],
    ),
    "phone": (
        ["part @", "isbn @ of", "order no. @", "page @ of it", "since @", "id @", "total: @", "v. @", "sum @", "item no. @", "pages @ of", "version @", "years @ in", "from @ on", "nr. @"],
        ["12-3#4-56##", "2019-2020-20##", "100 200 30##", "1990.123.45##", "978 3161 48##", "10.100.10##", "1999-2000-20##", "00 000 00##"],
    ),
}


def _synthetic(spark: SparkSession) -> DataFrame:
    """(id, fold, kind, y, text): each text holds one candidate; numbers come from hashes of the id."""
    dealt = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    pick = lambda options, k: F.element_at(F.array(*map(F.lit, options)), k + 1)
    parts = []
    for kind in KINDS:
        for y, source in ((1, _TRUE), (0, _FALSE)):
            frames, forms = source[kind]
            form = pick(forms, dealt(len(forms), 2))
            for salt in range(8):  # each # becomes a digit
                digit = dealt(10, 10 + salt).cast("string")
                if kind == "card" and y:  # the last digit is the check digit
                    passing = lambda form=form: F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string")), lambda d: F.call_function("luhn_check", F.concat(_digits(form), d)))
                    digit = F.when(form.rlike("^[^#]*#$"), passing()[0]).otherwise(digit)
                form = F.regexp_replace(form, F.lit("^([^#]*)#"), F.concat(F.lit("$1"), digit))
            frame = F.regexp_replace(pick(frames, 3 * dealt(len(frames) // 3, 1) + F.col("fold")), "#", "no ")
            one = F.concat(F.substring_index(frame, "@", 1), form, F.substring_index(frame, "@", -1))
            parts.append(F.struct(F.lit(kind).alias("kind"), F.lit(y).alias("y"), F.concat(F.lit("the words before "), one, F.lit(" and after")).alias("text")))
    ids = spark.range(0, SAMPLE // len(parts), 1, 1).withColumn("fold", F.pmod("id", F.lit(3)).cast("int"))
    return ids.select("id", "fold", F.explode(F.array(*parts)).alias("c")).select("id", "fold", "c.*")


@cache
def _model(spark: SparkSession) -> tuple[tuple[boosting.Tree, ...], dict[str, float], dict[str, tuple[float, float]]]:
    """Trees, each kind's threshold, and its precision and recall on frames that neither has seen; fitted once in a session.

    At most SAMPLE rows of features reach the driver.
    """
    rows = _synthetic(spark).withColumn("c", F.lit(None).cast("array<struct<start:int,end:int,x:array<double>>>"))
    for kind in KINDS:
        rows = rows.withColumn("c", F.when(F.col("kind") == kind, candidates(F.col("text"), kind)).otherwise(F.col("c")))
    got = rows.select("id", "fold", "kind", "y", F.explode("c").alias("c")).select("id", "fold", "kind", "y", "c.x").orderBy("kind", "y", "id").collect()
    x, y = np.array([r.x for r in got]), np.array([r.y for r in got], dtype=float)
    fold, kind = np.array([r.fold for r in got]), np.array([r.kind for r in got])
    trees = boosting.fit(x[fold == 0], y[fold == 0])
    score = boosting.raw(trees, x)
    least = {k: boosting.threshold(score[(fold == 1) & (kind == k)], y[(fold == 1) & (kind == k)], PRECISION) for k in KINDS}
    told = {}
    for k in KINDS:
        own = (fold == 2) & (kind == k)
        chosen, right = score[own] >= least[k], y[own] > 0
        told[k] = (float((chosen & right).sum() / max(chosen.sum(), 1)), float((chosen & right).sum() / right.sum()))
    return tuple(trees), least, told


def report(spark: SparkSession) -> dict[str, tuple[float, float]]:
    """Precision and recall of the loose candidates of each kind, on frames held out from fitting and calibration."""
    return _model(spark)[2]


def _selected(kind: str, trees: tuple[boosting.Tree, ...], least: float) -> Column:
    """The loose candidates of a kind that score ``least`` or more."""
    score = lambda c: let(c["x"], lambda x: boosting.expression(list(trees), x))
    scored = F.transform(F.col(f"loose_{kind}"), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit(kind).alias("kind"), score(c).alias("score")))
    return F.filter(scored, lambda c: c["score"] >= least)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``base`` and ``more``: spans (kind, start, end), by kind as listed and then start."""
    trees, least, _ = _model(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = common.narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    exact = slim.select("doc_id", "text", *(base(F.col("text"), k).alias(f"base_{k}") for k in KINDS), *(candidates(F.col("text"), k).alias(f"loose_{k}") for k in KINDS))
    every = F.concat(*(of_kind(k, F.col(f"base_{k}")) for k in KINDS))
    scored = [_selected(k, trees, least[k]) for k in KINDS]
    chosen = exact.select("doc_id", "text", *(f"base_{k}" for k in KINDS), every.alias("base"), F.concat(*scored).alias("scored"))
    more = F.array_sort(apart(F.col("scored"), F.col("base")))
    return chosen.select("doc_id", "text", *(F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS), "base", more.alias("more"))


def _all(sort_kind: bool) -> Column:
    own = F.concat(F.col("base"), F.transform("more", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    order = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    keyed = F.transform(own, lambda s: F.struct((order(s) if sort_kind else F.lit(0)).alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


def redact(docs: DataFrame, mark: str = "[PII]") -> DataFrame:
    """doc_id and the text with every selected span replaced."""
    return find(docs).select("doc_id", "text", merged(_all(False)).alias("gone")).select("doc_id", masked(F.col("text"), F.col("gone"), mark).alias("text"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *(f"n_{k}" for k in KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(_all(True)).alias("spans"),
        F.size("more").cast("long").alias("n_more"), (F.size("base") + F.size("more")).cast("long").alias("n_spans"),
    )
