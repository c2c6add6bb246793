import re

import numpy as np
import pytest

from pricelab.llm import quote_threads
from pricelab.llm.common import table

SCHEMA = "conv_id long, turn int, role string, text string"


def result(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", position int")
    return {(r.conv_id, r.position): r for r in quote_threads.conversations(df).collect()}


def test_nested_quotes_link_and_order(spark):
    got = result(spark, [
        (1, 0, "user", "Hello there world\nsecond line of text"), (1, 1, "assistant", "Some answer here"),
        (1, 2, "user", "> Hello there  WORLD\n> second line of text\n\nMy reply to the first"),
        (1, 3, "user", ">> Hello there world\n> My reply to the first\nDeep reply text"), (1, 4, "user", "unrelated message"),
        (1, 5, "user", "> no such passage\nfoo bar baz"), (1, 6, "user", "> > some answer here\nnested only"), (2, 3, "user", "> Some answer here\nother conversation")])
    order = [(got[1, k].turn, got[1, k].parent_turn, got[1, k].thread_turn, got[1, k].depth) for k in range(7)]
    assert order == [(0, None, 0, 0), (2, 0, 0, 1), (3, 2, 0, 2), (1, None, 1, 0), (6, 1, 1, 1), (4, None, 4, 0), (5, None, 5, 0)]
    assert got[1, 2].body == "Deep reply text" and got[1, 4].quote_level == 2
    assert got[2, 0].parent_turn is None and got[2, 0].body == "other conversation"


def test_odd_rows(spark):
    got = result(spark, [(1, 0, "user", None), (1, 0, "user", None), (1, 1, None, ""), (None, 0, "user", "x"), (1, None, "user", "> > quote only here"), (3, 0, "u", "a" * 300_000)])
    assert sorted(k[1] for k in got if k[0] == 1) == [0, 1, 2, 3]
    assert got[None, None].body == "x"
    assert len(got[3, 0].body) == 300_000
    assert quote_threads.conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_message_does_not_quote_itself_or_later_ones(spark):
    got = result(spark, [(1, 0, "u", "> later words come here\nfirst"), (1, 1, "u", "later words come here")])
    assert got[1, 0].parent_turn is None


def test_long_conversation_over_partitions(spark):
    rows = [(7, i, "user", f"message number {i}" if i % 3 else f"> message number {max(1, i - 2)}\nreply {i}") for i in range(600)]
    got = result(spark, rows)
    assert sorted(k[1] for k in got) == list(range(600))
    ordered = [got[7, k] for k in range(600)]
    assert [(r.thread_turn, r.turn) for r in ordered] == sorted((r.thread_turn, r.turn) for r in ordered)
    place = {r.turn: k for k, r in enumerate(ordered)}
    assert all(place[r.parent_turn] < place[r.turn] for r in ordered if r.parent_turn is not None)
    assert sum(r.parent_turn is not None for r in ordered) == 199


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_table_against_brute_force(spark, sf):
    messages = table(spark, f"/root/testdata/{sf}", "conversations")
    rows = sorted((r.conv_id, r.turn, r.text) for r in messages.collect())
    got = sorted((r.conv_id, r.position, r.turn, r.body) for r in quote_threads.conversations(messages).collect())
    assert [(c, t) for c, _, t, _ in got] == [(c, t) for c, t, _ in rows]  # the table has no quotes: turns in order
    assert [b for *_, b in got] == [x.lstrip("\n").rstrip() for *_, x in rows]


def linked(rows):
    """turn -> parent by brute force over one conversation of (turn, text)."""
    def normal(x):
        return " ".join(x.lower().split())

    def cut(text):
        out = []
        for line in text.split("\n"):
            marks = re.match(r"[ \t]*(?:>[ \t]*)+", line)
            level = marks.group().count(">") if marks else 0
            if not out or out[-1][0] != level:
                out.append((level, []))
            out[-1][1].append(line[marks.end():] if marks else line)
        return out

    def has(text, quote):
        own = ["\n".join(x) for level, x in cut(text) if level == 0]
        wholes = ["\n".join(own), *own, *(p for x in own for p in re.split(r"\n\s*\n", x))]
        lines = [[normal(y) for y in x.split("\n") if normal(y)] for x in own]
        asked = [normal(y) for y in quote if normal(y)]
        return normal(" ".join(quote)) in map(normal, wholes) or any(x[i : i + len(asked)] == asked for x in lines for i in range(len(x)))

    parents = {}
    for turn, text in rows:
        found = []
        for level, quote in cut(text):
            if level and normal(" ".join(quote)):
                first = min((t for t, x in rows if has(x, quote)), default=turn)
                if first < turn:
                    found.append((level, -first))
        parents[turn] = -min(found)[1] if found else None
    return parents


def test_partial_short_and_interleaved_quotes(spark):
    texts = ["one line\ntwo line\nthree line\nfour line\n\nsecond paragraph here\n\nthird paragraph here", "Yes.", "Why not", "> two line\n> three line\nA", "> Yes.\nB",
             "> second paragraph here\n>\n> third paragraph here\nC", "> one line\nreply first\nreply second\n> four line\nother first\nother second", "> other first\n> other second\nD",
             "> reply second\n> other first\nacross runs", "> one line\n> three line\nnot consecutive", "> two line three\n> line four line\nbroken elsewhere", "> one line two line\n> three line four line\nE"]
    got = {r.turn: r.parent_turn for r in result(spark, [(1, i, "u", t) for i, t in enumerate(texts)]).values()}
    assert got == linked(list(enumerate(texts)))
    assert [got[i] for i in (3, 4, 5, 6, 7, 8, 9, 11)] == [0, 1, 0, 0, 6, None, None, 0]


def test_random_quotes_against_brute_force(spark):
    rng, rows = np.random.default_rng(5), []
    for conv in range(6):
        for turn in range(25):
            lines = [("> " * int(rng.choice([0, 0, 1, 2])) + str(rng.choice(["a", "b", "c d", "", "e"]))) for _ in range(int(rng.integers(1, 7)))]
            rows.append((conv, turn, "u", "\n".join(lines)))
    got = {(r.conv_id, r.turn): r.parent_turn for r in result(spark, rows).values()}
    want = {(c, t): p for c in range(6) for t, p in linked([(t, x) for k, t, _, x in rows if k == c]).items()}
    assert got == want and sum(p is not None for p in want.values()) > 30
