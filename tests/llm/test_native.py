"""URL rules, line quality and source mixing on defined cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gavel.llm import mixing, quality, url_filter

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("a.b/x/y", "block"), ("a.b/x/", "allow"),
         ("bare", "block"), ("tie.org/", "allow"), ("tie.org/", "block")]


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))]
    best = None
    for rule, verdict in RULES:
        h, p = (rule[:rule.find("/")], rule[rule.find("/"):]) if "/" in rule else (rule, "")
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best, (len(rule), rule, verdict == "block")) if best else (
                len(rule), rule, verdict == "block")
    verdict = "allow" if best is None or not best[2] else "block"
    return host, path, best[1] if best else None, verdict


URLS = [None, "", "no scheme", "http://", "http://x.net", "http://x.NET/", "https://example.net/en/1?q#f",
        "http://www.example.net/de/", "http://a.b/x/yz", "http://a.b/x/z", "http://A.b/x", "ftp://q.bare?z",
        "http://tie.org/a", "http://net/", "http://xnet/", "a://b://c.net/", "http://.net//a", "http://é.net/é",
        "http://" + "s." * 500 + "net/" + "d/" * 500, "http://a.b/x/y/" * 3, "http://a.net:80/"]


def judged(spark, rows, rules=RULES):
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict int")
    out = url_filter.judge_urls(pages, url_filter.rule_table(spark, rules))
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("shuffled", [False, True])
def test_urls(spark, monkeypatch, shuffled):
    if shuffled:  # too many rules to broadcast
        monkeypatch.setattr(url_filter, "is_small", lambda df: False)
    rows = [(i, u, "clash", 0) for i, u in enumerate(URLS)] + [(1, "", "z", 0), (None, "http://x.net/", "", 1)]
    assert judged(spark, rows) == sorted(((i, *plain_verdict(u)) for i, u, _, _ in rows), key=repr)


def test_without_rules_or_rows(spark):
    assert judged(spark, []) == []
    pages = spark.createDataFrame([(1, "http://a.net/b")], "page_id long, url string")
    none = spark.createDataFrame([], "rule string, verdict string")
    assert [tuple(r) for r in url_filter.judge_urls(pages, none).collect()] == [
        (1, "a.net", "/b", None, "allow")]


def plain_repeats(words):
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    return len({i + d for i, w in enumerate(windows) if windows.count(w) > 1 for d in range(5)})


def cleaned(spark, texts):
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)],
                                 "doc_id long, text string, n_words int, _text string")
    return {r["doc_id"]: r for r in quality.clean_lines(docs).collect()}


def test_counts(spark):
    pick = random.Random(3)
    texts = [" ".join(pick.choice("ab") + pick.choice(" \n\t") for _ in range(pick.randrange(40)))
             for _ in range(30)]
    texts += ["a b c d e " * 3, "x " * 50, "", " \n ", "é# *\x0b|\n\né# *\x0b|", "a\x1cb c"]
    found = cleaned(spark, texts)
    for i, text in enumerate(texts):
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        r = found[i]
        assert (r["n_words"], r["word_chars"]) == (len(words), sum(map(len, words)))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == plain_repeats(words)
        assert r["base_failed"] == (len(words) < 10 or 100 * plain_repeats(words) > 20 * len(words))


def test_line_rules(spark):
    prose = "A plain sentence of some ten words that ends well, twice."
    bad = ["Home | News | Sport | Weather | About", "%%% ### &&& *** $$$", "BUY!! NOW!! OR!! NEVER!!",
           "no end to this line and no mark", "All Rights Reserved. Example 2024."]
    found = cleaned(spark, [prose, *["\n".join([prose, prose[::-1] + ".", b]) for b in bad],
                            "\n".join(bad) + "\n" + prose, None])
    assert found[0]["kept"] and found[0]["lost_chars"] == 0
    for i, b in enumerate(bad, 1):
        assert found[i]["kept"] and found[i]["lost_chars"] == len("".join(b.split()))
        assert b not in found[i]["clean_text"]
    assert not found[len(bad) + 1]["kept"] and not found[len(bad) + 1]["base_failed"]
    last = found[len(bad) + 2]
    assert last["clean_text"] is None and last["base_failed"] and not last["kept"] and last["n_words"] == 0


def test_very_long_text(spark):
    words = [f"w{i}" for i in range(60_000)]
    r = cleaned(spark, [" ".join([*words, *words[100:110]]) + "."])[0]
    assert (r["n_words"], r["n_repeat_words"]) == (60_010, 18) and r["kept"]


def test_scripts_and_languages(spark):
    clean = ["यह एक साफ़ वाक्य है जो ठीक से समाप्त होता है और दस शब्दों से लंबा है।",
             "هل هذا نص نظيف يحتوي على أكثر من عشر كلمات في سطر واحد فقط اليوم؟",
             "这 是 一 段 干净 的 中文 文本 有 超过 十 个 词。",
             "Սա մաքուր տեքստ է որը ունի ավելի քան տասը բառ մեկ տողում այսօր։"]
    bad = ["Tous Droits RÉSERVÉS par nous, 2024.", "Lea la POLÍTICA de privacidad.",
           "Unsere Datenschutzerklärung: hier.", "Cookie policy."]
    found = cleaned(spark, [*clean, *(f"{clean[0]}\n{x}" for x in bad)])
    for i, text in enumerate(clean):
        assert found[i]["kept"] and found[i]["clean_text"] == text
    for i in range(len(bad)):
        assert found[len(clean) + i]["clean_text"] == clean[0]


def test_quality_of_an_empty_table(spark):
    assert cleaned(spark, []) == {}


def test_exponent(spark):
    totals = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "source string, tokens long")
    step = 2.0 ** -mixing.ROUNDS
    a = mixing.bisect_exponent(totals, max_repeats=2.0)
    assert 90 ** (1 - a) <= 2 < 90 ** (1 - a + step)
    assert mixing.bisect_exponent(totals, max_repeats=1e9) == 0.0

    def entropy(a):
        w = [(t / 1000) ** a for t in (900, 90, 10)]
        return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)

    a = mixing.bisect_exponent(totals, target_entropy=0.9)
    assert entropy(a) <= 0.9 < entropy(a - step)
    assert mixing.bisect_exponent(totals, target_entropy=0.0) == 1.0


def test_mix(spark):
    pick = random.Random(8)
    docs = [(i, "w " * pick.randint(1, 9), s, 0) for i, s in enumerate("a" * 300 + "b" * 60 + "c" * 20)]
    docs += [(1000, None, "a", 0), (1001, "", "c", 0), (1002, None, "d", 0), (None, "n n", None, 0),
             (1003, "n " * 40, None, 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, epoch int")
    out = mixing.mix_sources(frame, max_repeats=3.5)
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "source", "n_tokens", "epoch", "block", "order_key"]
    shown, sizes = {}, {}
    for d, text, s, _ in docs:
        sizes.setdefault(s, []).append(len((text or "").split()))
    for r in rows:
        shown.setdefault(r["source"], []).append(r)
    totals = {s: sum(v) for s, v in sizes.items() if sum(v)}
    plan = {r["source"]: r for r in mixing.plan_epochs(
        spark.createDataFrame(list(totals.items()), "source string, tokens long"),
        mixing.bisect_exponent(spark.createDataFrame([(str(s), t) for s, t in totals.items()],
                                                     "source string, tokens long"), 3.5)).collect()}
    assert len(shown["d"]) == 1  # no tokens: each row once
    for s, total in totals.items():
        epochs, budget = plan[s]["epochs"], plan[s]["budget"]
        by_epoch = [[r for r in shown[s] if r["epoch"] == e] for e in range(epochs + 1)]
        assert all(len(x) == len(sizes[s]) for x in by_epoch[:-1]) and 1 <= plan[s]["repeats"] <= 3.5001
        last = sorted(by_epoch[-1], key=lambda r: r["order_key"])
        taken = sum(r["n_tokens"] for r in last)
        assert budget <= taken < budget + 41 and (budget or not last)
        whole = sorted(by_epoch[0], key=lambda r: r["order_key"])
        if len(last) > 20:  # another permutation than the first epoch's
            assert [r["doc_id"] for r in whole][:len(last)] != [r["doc_id"] for r in last]


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(empty).collect() == []
    none = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert len(mixing.mix_sources(none).collect()) == 1


def test_mixing_keeps_columns_of_any_name(spark):
    names = ["last_block", "last_doc", "_epochs", "_source", "block_key", "doc_key", "mix_key", "row"]
    frame = spark.createDataFrame(
        [(i, "a b c " * (1 + i % 3), "x" if i % 4 else "y", *range(8)) for i in range(30)],
        "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    out = mixing.mix_sources(frame)
    assert out.columns == [*frame.columns, "n_tokens", "epoch", "block", "order_key"]
    assert {tuple(r[n] for n in names) for r in out.collect()} == {tuple(range(8))}


def test_boilerplate_is_looked_for_only_where_it_may_be(spark):
    """The cheap look at a whole text misses no phrase, whatever its letters' case."""
    phrases = [p for some in quality.PHRASES.values() for p in some]
    odd = [p.replace("i", "İ").replace("s", "ſ") for p in phrases] + [
        p.upper().replace("I", "ı").replace("K", "K") for p in phrases]
    texts = [*phrases, *map(str.upper, phrases), *odd, "a plain line, read with care", "", None]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", F.rlike("t", F.lit(f"(?iu){quality.BOILERPLATE}")).alias("phrase"),
        quality.may_have_boilerplate(F.col("t")).alias("maybe")).collect()
    assert sum(bool(r.phrase) for r in found) == 4 * len(phrases)
    assert all(r.maybe for r in found if r.phrase)
    assert [r.maybe for r in found[-3:]] == [False, False, None]
