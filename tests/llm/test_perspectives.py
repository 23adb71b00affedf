"""Perspectives against a plain rendering and against the SQL of the query."""

import random

import duckdb
import pytest

from spendframe.llm.oracles import OP10
from spendframe.llm.perspectives import rotate
from spendframe.llm.queries import op10_perspectives

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain(rows, part_chars):
    out = set()
    for conv in {r[0] for r in rows}:
        turns = [(t, (r or "unknown").replace("<|", "< |"), (x or "").replace("<|", "< |")) for c, t, r, x in rows if c == conv]
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        marks = ["<|system|>\n" if role == "system" else f"<|user:{role}|>\n" for _, role, _ in turns]
        at, parts = 0, []
        for mark, (_, _, said) in zip(marks, turns):
            parts.append(at // part_chars)
            at += len(mark) + len(said) + len("<|end|>\n")
        for speaker in {role for _, role, _ in turns} - {"system"}:
            done, pieces = 0, {}
            for part, mark, (_, role, said) in zip(parts, marks, turns):
                mark = "<|assistant|>\n" if role == speaker else mark
                held = pieces.setdefault(part, [0, done, "", []])
                held[0] += 1
                held[2] += mark + said + "<|end|>\n"
                if role == speaker:
                    held[3].append((done + len(mark), done + len(mark) + len(said)))
                done += len(mark) + len(said) + len("<|end|>\n")
            out |= {(conv, part, speaker, n, start, text, tuple(mask)) for part, (n, start, text, mask) in pieces.items()}
    return out


def found(frame, **settings):
    rows = rotate(frame, **settings).collect()
    return [(r.conv_id, r.part, r.speaker, r.n_turns, r.start, r.text, tuple((s.start, s.end) for s in r.mask)) for r in rows]


def test_rotation(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "ann", "Hé"), (1, 2, "bob", "😀 yes"), (1, 3, "cy", None), (1, 3, "ann", "tie"),
        (1, 7, "ann", "late"), (2, 1, None, "who <|end|> am I"), (2, 2, "user", ""), (2, 2, "user", ""), (None, 0, "user", "lost"),
        (None, 0, "ann", "too"), (3, None, "user", "no turn"), (3, 0, "assistant", "x" * 50_000), (3, 1, "user", "after"),
        (4, 0, "system", "alone"), (5, -1, "user", "before"), (6, None, "a<|b", ""), (6, None, "a<|b", ""), (6, None, "c", None),
    ]
    frame = spark.createDataFrame([(*r, 1, "m") for r in rows], SCHEMA + ", part int, mask string")
    for part_chars in (1, 40, 100, 1 << 18):
        got = found(frame, part_chars=part_chars)
        assert len(got) == len(set(got)) and set(got) == plain(rows, part_chars)
    assert rotate(frame.limit(0)).collect() == [] == rotate(frame.where("conv_id = 4")).collect()
    with pytest.raises(ValueError):
        rotate(frame, part_chars=0)


def test_parts_are_one_dialogue(spark):
    """One conversation without turn numbers holds most rows; its parts in order hold what it is as a single one."""
    dice = random.Random(5)
    rows = [(9, None, dice.choice(["ann", "bo", "system", None]), dice.choice("abc") * dice.randrange(30)) for _ in range(700)]
    rows += [(c, t, "user", "short") for c in range(5) for t in range(3)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    single = {r[:3]: r for r in found(frame)}
    joined = {}
    for conv, part, speaker, n, start, text, mask in sorted(found(frame, part_chars=500), key=lambda r: (r[0], r[2], r[1])):
        held = joined.setdefault((conv, 0, speaker), [0, "", ()])
        assert start == len(held[1])
        held[0], held[1], held[2] = held[0] + n, held[1] + text, held[2] + mask
    assert {k: (n, 0, text, mask) for k, (n, text, mask) in joined.items()} == {k: r[3:] for k, r in single.items()}


def test_sql_on_a_long_conversation(spark, tmp_path):
    """More than one part with the production setting, where turns by number would be cut elsewhere."""
    rows = [(1, t // 2, ("ann", "bo", "system")[t % 3], f"{t} " + "y" * (t % 1400)) for t in range(900)]
    rows += [(2, t, "ann", "z") for t in range(600)] + [(None, None, "bo", None)] * 2
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    frame = op10_perspectives(spark, str(tmp_path))
    cursor = duckdb.connect()
    cursor.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    cursor.execute(OP10)
    columns = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    got = [tuple(r) for r in frame.select(*columns).collect()]
    assert sorted(columns) == sorted(frame.columns)
    assert len(got) == len(want) and set(got) == set(want)
    assert max(r[columns.index("part")] for r in want) >= 1 and sum(r[columns.index("conv_id")] == 2 for r in want) == 1


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b" * 90)], SCHEMA)
    plan = rotate(frame, part_chars=50)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
