"""Quotation linking on hand-made and random conversations, against the registered SQL and plain Python."""

import random

import duckdb
import pytest
from slotstream.llm import chat, queries

ROWS = [
    (1, 0, "user", "How do I sort a list?\nThanks"),
    (1, 1, "assistant", "> How do I sort a list?\nUse sorted()."),
    (1, 2, "user", "A different topic"),
    (1, 3, "user", ">> how do I  SORT a list?\n> Use sorted().\nIn place?"),
    (1, 4, "assistant", "> In place?\n> A different topic\n> Use sorted().\nlist.sort()"),
    (1, 5, "assistant", "> nobody said this\nplain"),
    (1, 6, "user", "> In place?"),
    (2, 0, "user", None),
    (2, 1, "user", ""),
    (2, 2, "user", "> A different topic\n\n  x  "),
    (None, 0, "user", "> How do I sort a list?"),
    (3, None, "user", "x"),
]
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_links_and_threads(spark):
    got = {(r.conv_id, r.turn): r for r in chat.formatted(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert len(got) == len(ROWS)
    parent = {k: (r.parent_turn, r.thread, r.depth, r.place) for k, r in got.items()}
    assert parent[(1, 0)] == (None, 0, 0, 0) and parent[(1, 1)] == (0, 0, 1, 1) and parent[(1, 3)] == (1, 0, 2, 2)
    assert parent[(1, 4)] == (3, 0, 3, 3)  # three turns tie with a line each; the latest wins
    assert parent[(1, 5)] == (None, 5, 0, 0) and parent[(1, 6)] == (3, 0, 3, 4)
    assert parent[(2, 2)] == (None, 2, 0, 0) and parent[(None, 0)] == (None, 0, 0, 0)
    assert got[(1, 3)].text == "In place?" and got[(1, 6)].text == "" and got[(2, 0)].text is None
    assert got[(1, 3)].max_level == 2 and got[(1, 3)].n_linked == 2 and got[(1, 3)].n_quoted == 2


def test_wrapped_passages_and_reply_order(spark):
    rows = [
        (7, 0, "a", "the first paragraph is\nwrapped here\n\nand a second one"),
        (7, 1, "b", "> The first paragraph\n> is wrapped   here\nyes"),
        (7, 2, "c", "> and a second\n> one\nno"),
        (7, 3, "d", "> yes\nreally"),
        (7, 4, "e", "> the first paragraph is\nagain"),  # a line, no whole passage
        (7, 5, "f", "> > the first\n> > paragraph is wrapped here\n> yes\nsure"),
    ]
    got = {r.turn: r for r in chat.formatted(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {t: (r.parent_turn, r.place, r.n_linked) for t, r in got.items()} == {0: (None, 0, 0), 1: (0, 1, 2), 3: (1, 2, 1), 5: (1, 3, 3), 2: (0, 4, 2), 4: (0, 5, 1)}


def conversations():
    r, rows = random.Random(12), []
    for conv in range(12):
        said = []
        for turn in range(r.randint(1, 30)):
            lines = []
            for _ in range(r.randint(0, 3)):
                if said and r.random() < 0.7:
                    words = " ".join(r.choice(said)).split()
                    level = r.randint(1, 3)
                    cut = r.randint(1, len(words))
                    for part in (words[:cut], words[cut:]) if r.random() < 0.5 else (words,):
                        lines += [r.choice([">" * level, "> " * level, " >" * level + " "]) + " ".join(part)]
                if r.random() < 0.3:
                    lines.append(r.choice(["", ">", "  "]))
            own = [" ".join(r.choice("yes no maybe so It IS".split()) for _ in range(r.randint(1, 4))) for _ in range(r.randint(0, 3))]
            rows.append((conv, turn * 3, "u", "\n".join(lines + own)))
            said += [own] if own else []
    return rows


@pytest.mark.parametrize("rows", [[r for r in ROWS if r[0] is not None and r[1] is not None] + [(9, i, "user", f"> line {i - 1}\n> line {i // 2}\nline {i}") for i in range(40)], conversations()])
def test_matches_sql(spark, rows):
    frame = chat.formatted(spark.createDataFrame(rows, SCHEMA))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = con.sql(queries.ORACLE_SQL["op10_chat_formatting"])
    key = lambda r: (r[0], r[1])
    got = sorted(map(tuple, frame.select(*want.columns).collect()), key=key)
    assert got == sorted(want.fetchall(), key=key)
    assert sum(r[want.columns.index("n_linked")] > 0 for r in got) > 5


def test_long_marks_repeated_rows_and_extra_columns(spark):
    rows = [(1, 0, "user", "said", 5, "p"), (1, 1, "user", ">" * 1_000_000 + "deep\n> said\nown", 6, "q"), (1, 1, "user", "> said\nown", 7, "r"), (1, 1, "user", "> said\nown", 7, "r")]
    frame = chat.formatted(spark.createDataFrame(rows, SCHEMA + ", id int, thread string"))
    assert frame.columns == [*chat.RESULT, "id"]
    got = sorted(frame.collect(), key=lambda r: r.id)
    assert [(r.turn, r.parent_turn, r.place, r.text, r.id) for r in got] == [(0, None, 0, "said", 5), (1, 0, 1, "own", 6), (1, 0, 1, "own", 7), (1, 0, 1, "own", 7)]
    assert got[1].max_level == 1_000_000


def test_empty_table(spark):
    assert chat.formatted(spark.createDataFrame([], SCHEMA)).count() == 0
