import itertools
import random

import pytest

from gavel.llm.line_dedup import MIN_TOKENS, dedup_lines

SCHEMA = "doc_id long, text string"


def one_token_apart(x: list[str], y: list[str]) -> bool:
    """Whether one insertion, deletion or replacement makes two lists equal, or none is needed."""
    if abs(len(x) - len(y)) > 1:
        return False
    start = 0
    while start < min(len(x), len(y)) and x[start] == y[start]:
        start += 1
    end = 0
    while end < min(len(x), len(y)) - start and x[-1 - end] == y[-1 - end]:
        end += 1
    return max(len(x), len(y)) - start - end <= 1


def brute(docs):
    """Texts with the lines removed that match a line at an earlier place."""
    first = {}
    for d, text in docs:
        if d is not None and text is not None:
            for n, line in enumerate(text.split("\n")):
                trimmed = line.strip(" \t\r\x0b\x0c")
                if trimmed:
                    first[trimmed] = min((d, n), first.get(trimmed, (d, n)))
    long = [(line.split(" "), place) for line, place in first.items()
            if len(line.split(" ")) >= MIN_TOKENS]
    by_size = {}
    for tokens, place in long:
        by_size.setdefault(len(tokens), []).append((tokens, place))
    # Each distinct line against all others of about its length.
    earliest = dict(first)
    for tokens, _ in long:
        line = " ".join(tokens)
        for size in (len(tokens) - 1, len(tokens), len(tokens) + 1):
            for other, place in by_size.get(size, []):
                if place < earliest[line] and one_token_apart(tokens, other):
                    earliest[line] = place
    out = []
    for d, text in docs:
        if d is None or text is None:
            out.append((d, text, 0))
            continue
        kept, gone = [], 0
        for n, line in enumerate(text.split("\n")):
            trimmed = line.strip(" \t\r\x0b\x0c")
            if trimmed and earliest[trimmed] < (d, n):
                gone += 1
            else:
                kept.append(line)
        out.append((d, "\n".join(kept), gone))
    return sorted(out, key=repr)


def run(spark, docs):
    rows = dedup_lines(spark.createDataFrame(docs, SCHEMA)).collect()
    return sorted([(r["doc_id"], r["text"], r["n_removed"]) for r in rows], key=repr)


def changed(random_, words):
    words = list(words)
    for _ in range(random_.choice([0, 1, 1, 1, 2])):
        at, kind = random_.randrange(len(words)), random_.random()
        if kind < 0.4:
            words[at] = random_.choice("xyz")
        elif kind < 0.7:
            words.insert(at, random_.choice("ab"))
        elif len(words) > 1:
            del words[at]
    return words


@pytest.mark.parametrize("seed", range(3))
def test_agrees_with_brute_force(spark, seed):
    pick = random.Random(seed)
    bases = [[pick.choice("abcde") for _ in range(pick.choice([3, 7, 8, 9, 12]))] for _ in range(6)]
    docs = []
    for i in range(24):
        lines = [" ".join(changed(pick, pick.choice(bases))) for _ in range(pick.randrange(5))]
        docs.append((i, "\n".join(lines)))
    pick.shuffle(docs)
    assert run(spark, docs) == brute(docs)


def test_one_token_apart(spark):
    base = "one two three four five six seven eight nine"
    near = [base.replace("one", "1"), base.replace("nine", "9"), base.replace("five ", ""),
            base + " ten", "zero " + base, base.replace("four", "4"), "x " + base.replace("nine", "9")]
    docs = [(i, t) for i, t in enumerate([base, *near])]
    assert [x[2] for x in sorted(run(spark, docs))] == [0, 1, 1, 1, 1, 1, 1, 1]
    assert run(spark, docs) == brute(docs)


def test_defined_cases(spark):
    line = "a b c d e f g h"
    docs = [(1, line), (1, line), (2, f"{line}\n\n \n{line}"), (3, None), (4, ""), (None, line),
            (5, " \t" + line + "\r"), (6, "short"), (7, "short\nlonger")]
    got = {k: list(v) for k, v in itertools.groupby(run(spark, docs), key=lambda x: x[0])}
    assert [x[1:] for x in got[1]] == [(line, 0), (line, 0)]  # a repeated row is one place
    assert got[2] == [(2, "\n ", 2)] and got[3] == [(3, None, 0)] and got[4] == [(4, "", 0)]
    assert got[None] == [(None, line, 0)] and got[5] == [(5, "", 1)]
    assert got[7] == [(7, "longer", 1)]


def test_extra_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "x y", 5, "a", "b", "c", "d", "e")], SCHEMA + (
        ", n_lines int, doc string, h1 string, gone string, text_hash string, row string"))
    out = dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "doc", "h1", "gone", "text_hash", "row", "n_lines", "n_removed"]
    assert [tuple(r) for r in out.collect()] == [(1, "x y", "a", "b", "c", "d", "e", 1, 0)]
    assert dedup_lines(docs.where("false")).collect() == []


def test_very_long_line(spark):
    words = [f"w{i}" for i in range(20_000)]
    other = [*words[:9_000], "changed", *words[9_001:]]
    got = run(spark, [(1, " ".join(words)), (2, " ".join(other))])
    assert [x[2] for x in got] == [0, 1]
