"""Quality rules, language identification and URL rules against brute-force versions."""

import re
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lamella.llm import common, language_id, quality_rules, registry, url_filter

WORD = re.compile("[^\x20\x09-\x0d]+")


def measured(text):
    text = text or ""
    words, seen, again = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    count, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if count[w] > 1:
            covered |= {k, k + 1, k + 2}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, len(covered)


def ours(texts):
    m = quality_rules.measure(pa.array(texts, pa.string()))
    return [tuple(int(m[k][i]) for k in quality_rules.MEASURES[:5]) for i in range(len(texts))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a", "b", "é", "😀", " ", "\n", "\t", "\r\n", "\u00a0", "#", "|", "ab", "\x0b", "\x1c"]), max_size=40).map("".join)), max_size=8))
def test_measures(texts):
    assert ours(texts) == [measured(t) for t in texts]


def test_measures_of_long_texts():
    texts = ["a b c " * 200_000, "x" * 3_000_000, "line\n" * 100_000, None, ""]
    assert ours(texts) == [measured(t) for t in texts]


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["a", "b", "é", "😀", " ", "\n", "\t", "\r\n", "\u00a0", "#", "ab cd", "a b\n", "\x0b", "x" * 20]), max_size=60).map("".join))
def test_measures_piece_by_piece(monkeypatch, text):
    monkeypatch.setattr(common, "SLICE_BYTES", 16)  # longer texts go by pieces
    m = {k: v[0] for k, v in quality_rules.measure(pa.array([text])).items()}
    monkeypatch.undo()
    assert m == {k: v[0] for k, v in quality_rules.measure(pa.array([text])).items()}
    assert tuple(m[k] for k in quality_rules.MEASURES[:5]) == measured(text)


def test_long_texts_take_bounded_memory(docs):
    import tracemalloc

    model = language_id.model_of(docs([(k, t) for k, _, t in corpus(10)], {k: g for k, g, _ in corpus(10)}))
    text = pa.array([LANGS["xx"] * (100_000_000 // len(LANGS["xx"])) + "\n"], pa.large_string())
    for run, most in ((lambda: language_id.predict(model, text)[0], 5), (lambda: quality_rules.measure(text)["n_words"][0], 9)):
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most * 100_000_000


def test_ledger_query(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = registry.queries()["op9_quality_rules"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, chars, symbols, lines, repeats = measured(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert not (r.kept and r.base_failed)


def test_rules_find_low_quality_and_spare_the_rest(spark, small):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    rows = registry.queries()["op9_quality_rules"](spark, small).collect()
    assert not any(r.kept for r in rows if labels.get(r.doc_id) == 0)
    assert all(r.kept for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed)


def test_policies_and_ablations(docs):
    good = " ".join(f"word{k}" for k in range(60))
    texts = [good, "short", None, "### " * 80, good + " #" * 40, "a b c " * 50]
    rows = quality_rules.ledger(docs(texts)).cache()
    bits = {r.doc_id: r.failed for r in rows.collect()}
    assert bits[0] == 0
    assert bits[2] == quality_rules.BIT["too_short"]
    assert bits[4] == quality_rules.BIT["symbols"]
    assert {r.doc_id for r in rows.where(quality_rules.passes("base-1")).collect()} == {0, 4}
    got = {r.rule: tuple(r)[1:] for r in quality_rules.ablations(rows).collect()}
    for rule, bit in quality_rules.BIT.items():
        failed = [d for d, b in bits.items() if b & bit]
        alone = [d for d, b in bits.items() if b == bit]
        assert got[rule] == (len(failed), len(alone), len(alone) + 1)


def test_keep_is_the_ledgers_verdict(docs):
    good = " ".join(f"word{k}" for k in range(60))
    table = docs([good, "short", None, good, (None, good), good + " #" * 40])
    for policy in quality_rules.POLICIES:
        kept = quality_rules.keep(table, policy)
        assert kept.columns == table.columns
        assert kept.count() == quality_rules.ledger(table).where(quality_rules.passes(policy)).count()
    assert quality_rules.keep(docs([])).count() == 0
    assert quality_rules.ablations(quality_rules.ledger(docs([]))).count() == 0


LANGS = {"xx": "the and of ing tion", "yy": "der und ich sch ung", "zz": "les eau oui que ment"}


def corpus(n):
    rng = np.random.default_rng(1)
    return [(k, lang, " ".join(rng.choice(words.split(), 25))) for k, (lang, words) in enumerate(list(LANGS.items()) * n)]


def test_languages(docs, spark):
    rows = corpus(40)
    extra = [(1000, None), (1001, ""), (1002, "12 34 !!"), (None, LANGS["yy"]), (1003, "é"), (1004, LANGS["xx"] * 3000)]
    lang = {k: g for k, g, _ in rows} | {1000: "xx", 1001: "xx", 1002: None, None: "yy"}
    table = docs([(k, t) for k, _, t in rows] + extra, lang)
    got = {r.doc_id: r for r in language_id.identify(table).collect()}
    assert len(got) == len(rows) + len(extra)
    for k, g, _ in rows:
        assert got[k].lang_pred == g
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2)
        assert 0.5 < got[k].score <= 1
    assert [got[k].lang_pred for k in (1000, 1001, 1002, None, 1004)] == ["und", "und", "und", "yy", "xx"]
    assert [got[k].score for k in (1000, 1001, 1002)] == [0, 0, 0]
    kept = language_id.keep(table)
    assert kept.columns == table.columns
    ids = {r[0] for r in kept.collect()}
    assert not ids & {1000, 1001, 1002}
    assert {k for k, _, _ in rows} <= ids


def test_the_held_out_fold_is_not_learned_from(docs):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 4 == 2)
    model = language_id.model_of(docs([(held, "only here"), (held + 100_000, None)], {held: "qq"}))
    assert "qq" not in model.languages


def test_prediction_depends_on_the_text_alone(docs):
    rows = corpus(10)
    model = language_id.model_of(docs([(k, t) for k, _, t in rows], {k: g for k, g, _ in rows}))
    texts = [t for _, _, t in rows]
    together = language_id.predict(model, pa.array(texts))
    for k, t in enumerate(texts):
        alone = language_id.predict(model, pa.array([t]))
        assert alone[0][0] == together[0][k]
        assert abs(alone[1][0] - together[1][k]) < 1e-12


def brute_model(rows):
    """Weights and expected margins from counts by language, one bucket, bit and language after the other."""
    languages = sorted({g for g, _ in rows})
    seen = np.zeros((len(languages), language_id.BUCKETS))
    for lang, text in rows:
        data = text.lower().encode()
        for k in range(len(data) + 1):
            b = (b"  " + data + b" ")[k : k + 3]
            two = (int.from_bytes(b[1:], "big") | 1 << 24) * 2654435761 % (1 << 32) >> 17
            three = int.from_bytes(b, "big") * 2654435761 % (1 << 32) >> 17
            for g in (b[2], two, three):
                seen[languages.index(lang), g] += 1
    share = (seen + language_id.SMOOTHING) / (seen + language_id.SMOOTHING).sum(1, keepdims=True)
    code = language_id.codewords(len(languages))
    weights = np.stack([np.log(share[code[:, k] > 0].mean(0)) - np.log(share[code[:, k] < 0].mean(0)) for k in range(code.shape[1])], axis=1)
    return languages, code, weights, share @ weights


def test_the_model_against_brute_force(docs, monkeypatch):
    rows = [(g, t) for _, g, t in corpus(3)] + [("zz", "Ünd É 12"), ("zz", ""), ("vv", "qqq"), ("uu", "a long text " * 9)]
    monkeypatch.setattr(language_id, "VECTORS_HELD", 2)
    monkeypatch.setattr(language_id, "PIECE", 16)
    monkeypatch.setattr(common, "SLICE_BYTES", 16)
    monkeypatch.setattr(language_id, "LOSSES", 100)
    table = docs([t for _, t in rows], dict(enumerate(g for g, _ in rows)))
    model = language_id.fit(common.narrow(table, "text", "lang"))
    languages, code, weights, expected = brute_model(rows)
    assert model.languages == languages
    assert (model.code == code).all()
    assert np.abs(model.weights - weights).max() < 1e-5
    assert np.abs(model.expected - expected).max() < 1e-6
    got, score, unsure, loss = language_id.predict(model, pa.array([t for _, t in rows]))
    for k, (_, text) in enumerate(rows):
        if not any(c.isalpha() for c in text):
            assert (got[k], score[k], unsure[k], loss[k]) == ("und", 0, False, 0)
            continue
        data, margin = text.lower().encode(), np.zeros(code.shape[1])
        for i in range(len(data) + 1):
            b = (b"  " + data + b" ")[i : i + 3]
            for g in (b[2], (int.from_bytes(b[1:], "big") | 1 << 24) * 2654435761 % (1 << 32) >> 17, int.from_bytes(b, "big") * 2654435761 % (1 << 32) >> 17):
                margin += weights[g] / (3 * len(data) + 3)
        losses = [sum(model.trust[b] * np.logaddexp(0, -4 * code[i, b] * margin[b] / max(abs(expected[i, b]), 1e-3)) for b in range(code.shape[1])) for i in range(len(languages))]
        assert got[k] == languages[int(np.argmin(losses))]
        assert abs(loss[k] - min(losses)) < 1e-4


def test_many_languages(docs):
    rng = np.random.default_rng(3)
    syllables = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 3)) for _ in range(1_200)]
    own = {f"l{k:03}": [syllables[2 * k], syllables[2 * k + 1], syllables[rng.integers(1_200)]] for k in range(600)}
    rows = [(n, " ".join(rng.choice(w, 40))) for n, w in enumerate(list(own.values()) * 2)]
    lang = {n: g for n, g in enumerate(list(own) * 2)}
    model = language_id.fit(common.narrow(docs(rows, lang), "text", "lang"))
    assert len(model.languages) == 600
    found = language_id.predict(model, pa.array([t for _, t in rows]))[0]
    assert np.mean([g == lang[n] for n, g in enumerate(found)]) > 0.9


def test_codewords():
    for n in (2, 3, 4, 7, 30, 100):
        code = language_id.codewords(n)
        assert len({tuple(c) for c in code}) == n
        assert all(abs(code[:, b].sum()) < n for b in range(code.shape[1]))
    assert len(language_id.codewords(0)) == 0


def test_no_labels_and_one_language(docs):
    assert {r.lang_pred for r in language_id.identify(docs(["some text", "more"], {0: None, 1: None})).collect()} == {"und"}
    assert {r.lang_pred for r in language_id.identify(docs([(k, "some text") for k in range(9)], {k: "en" for k in range(9)})).collect()} == {"en"}
    assert language_id.identify(docs([])).count() == 0


def test_held_out_accuracy(spark):
    rows = registry.queries()["op8_language_id"](spark, "/root/testdata/sf0.01").where("held_out")
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right, n = rows.join(lang, "doc_id").selectExpr("count_if(lang = lang_pred)", "count(*)").first()
    assert n > 200
    assert right / n > 0.99


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = []
    for verdict, rule in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")):
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail):
            fits.append((len(rule), rule, verdict))
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    low = (host + path).translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    word = any(re.search(r.pattern, low) for r in url_filter.PATTERN_RULES)
    return host, path, None, "block" if word else "allow"


URLS = [
    None, "", "no scheme", "http://", "https://Example.NET/en/1", "https://a.example.net/en/1?x=/de/", "https://a.example.net/EN/1", "https://example.net/en", "https://example.net", "http://x.net?y", "http://netx/", "http://net/", "http://mynet/",
    "http://example.com/de/", "http://example.com/de", "http://b.example.com/den/x", "http://notexample.com/de/", "ftp://x.org/fr/#f", "http://x.org/fr", "http://org/fr/a://b", "http://spam-farm.example.com/", "http://spam-farms.example.com/", "http://x.com/CASINO",
    "http://x.com/casino", "http://é.net/ü", "http://x.com/" + "a" * 50_000, "x://y.org/fr/casino", "http://x.com/a-casino-b?net/", "://h.net/p",
    "http://x.com/Casino", "http://x.com/CGI-BIN/a", "http://x.com/wp-login.php", "http://ads12.x.com/", "http://a.x.com/ads/300x250/b", "http://x.com/ads/1x/", "http://tracker.com/Poker_", "http://x.com/pokers",
]


def test_urls(spark):
    rows = [(k, u, "<p>", "x", 1) for k, u in enumerate(URLS)] + [(None, "http://net/", None, None, None), (0, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, token string, id int")
    got = sorted((r.page_id is None, r.page_id or 0, (r.host, r.path, r.rule, r.verdict)) for r in url_filter.judge(pages).collect())
    wanted = sorted((p is None, p or 0, judged(u)) for p, u, *_ in rows)
    assert [str(g) for g in got] == [str(w) for w in wanted]
    assert url_filter.judge(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, []).collect()} == {"allow"}


def test_rules_are_filed_under_tokens_that_their_urls_hold():
    assert url_filter.host_rule("block", "a.example.com/some/pre").literals == ("a", "example", "com")
    wanted = {
        "abc": (), "^abc$": ("abc",), "/abc/": ("abc",), "/abc-def": ("abc",), "-abc.def-": (), "-abc[.]def-": ("abc", "def"), "(?:^|[^a-z0-9])a1(?:[^a-z0-9]|$)": ("a1",), "/(?:abc|def)/": (), "/(abc)/x?/d/": ("abc", "d"),
        "/abc+/": (), "(?:/abc/)+": ("abc",), "/ab(?:c/)*/": (), r"\babc\b": ("abc",), r"\Babc\b": (), "/abc(?=d)/": (), "[^/]*-abc-": ("abc",), "-é-ab-": ("ab",), "^.*/wp/.*$": ("wp",), "/[0-9]+x/": (), r"\wabc\W": (),
    }
    assert {p: url_filter.literals(p) for p in wanted} == wanted


PIECES = ["ab", "c1", "d", "/", "-", ".", "_", "x", "é", "AB"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["ab", "c1", "d", "/", "-", "[.]", "_", ".", "[a-z]", "(?:ab|c1)", "(ab-)+", "(?:/d)?", "^", "$", r"\b", "(?:^|/)", "[^a-z0-9]", "x*", "é"]), max_size=6).map("".join), st.lists(st.sampled_from(PIECES), max_size=10).map("".join))
def test_literals_are_necessary(pattern, url):
    low = url.lower()
    if re.search(pattern, low, re.A):
        assert set(url_filter.literals(pattern)) <= set(re.split(url_filter.TOKEN_GAP, low))


def test_many_rules_against_brute_force(spark):
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefg"), 3)) for _ in range(400)]
    pick = lambda n: [words[k] for k in rng.integers(0, 400, n)]
    table = []
    for k in range(10_000):
        a, b, c = pick(3)
        kind, pattern = [("word", f"{a}-{b}"), ("glob", f"*/{a}/{b}*{c}"), ("regex", f"[-/]{a}[0-9]?/(?:{b}|{c})(?:/|$)"), ("host", f"{a}.{b}.com/{c}/")][k % 4]
        table.append((f"r{k}" if kind != "host" else pattern, ["block", "allow"][k % 3 == 0], kind, pattern))
    table += [("bare", "block", "regex", "[0-9]{4}"), ("dots", "allow", "glob", "*..*")]
    rules = url_filter.rules_of(table)
    urls = [f"http://{'.'.join(pick(2))}.com/{'/'.join(pick(3)).title()}{['', '-' + pick(1)[0], '2024', '/' + pick(1)[0], '..'][k % 5]}" for k in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict, r.pattern) for r in url_filter.judge(pages, rules).collect()}
    compiled = [(r, re.compile(r.pattern)) for r in rules]
    for k, url in enumerate(urls):
        text = url.removeprefix("http://")
        hosts = [r for r, p in compiled if r.base and p.search(text)]
        if hosts:
            best = max(hosts, key=lambda r: len(r.name))
            assert got[k][1] in {r.verdict for r in hosts if len(r.name) == len(best.name)}
            assert len(got[k][0]) == len(best.name)
            continue
        first = next((r for r, p in compiled if not r.base and p.search(text.lower())), None)
        assert got[k] == (None, first.verdict if first else "allow", first.name if first else None)
    assert sum(p is not None for _, _, p in got.values()) > 50
