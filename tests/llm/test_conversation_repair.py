"""Repairs against a search over all edit strings, and the whole query against plain Python."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from spendframe.llm import conversation_repair as cr
from spendframe.llm import queries
from spendframe.llm.base import table

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows: list[tuple[str, str | None]]) -> tuple[int, str]:
    """Least (cost, edits) of (initial, fault) rows: shortest paths over (rows done, last initial), strings and all."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if at == len(rows) and state in ("", "a"):
            return cost, audit
        if (cost, audit, at, state) in seen or len(audit) > 2 * len(rows) + 4:
            continue
        seen.add((cost, audit, at, state))
        for to in "ua":
            if (state, to) in NEXT:
                heapq.heappush(heap, (cost + 2, audit + "I", at, to))
        if at < len(rows):
            initial, fault = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            if (state, initial) in NEXT:
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, initial))
            for to in "ua":
                if (state, to) in NEXT:
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, to))
    raise AssertionError("no repair")


def searched(rows):
    search, out = cr.Search(), []
    for k, (initial, fault) in enumerate(rows):
        search.step(initial, fault == "truncated", fault in ("blank", "duplicate"), k)
        out += search.final()
    cost, rest = search.end()
    return cost, out + rest, search


@pytest.mark.parametrize("look", [1, 64])
def test_search_equals_all_strings(monkeypatch, look):
    monkeypatch.setattr(cr, "LOOK", look)  # 1: edits are emitted as soon as they are final
    dice = random.Random(5)
    for _ in range(1500):
        rows = [(dice.choice("suaaut "), dice.choice([None, None, None, "truncated", "blank", "duplicate"])) for _ in range(dice.randint(0, 7))]
        cost, edits, _ = searched(rows)
        assert (cost, "".join(e for e, _, _ in edits)) == cheapest(rows), rows
        assert [row for e, _, row in edits if e != "I"] == list(range(len(rows)))


def test_final_edits_leave_memory():
    for pattern in ("ua", "u", "t", "suau"):
        search, most, emitted = cr.Search(), 0, 0
        for k in range(4000):
            search.step(pattern[k % len(pattern)], False, k % 97 == 5, k)
            emitted += len(list(search.final()))
            most = max(most, search.open)
        if len(pattern) > 1:  # one role again and again leaves two repairs of unlike first edits open to the end
            assert most <= 4 * cr.LOOK and emitted > 3000
        nodes, stack = 0, [search.alive[s][1] for s in search.alive]
        seen = set()
        while stack:
            node = stack.pop()
            if id(node) not in seen and node is not search.root:
                seen.add(id(node))
                stack.append(node.parent)
        assert len(seen) <= 4 * (search.open + 2)


def by_hand(rows):
    """The contract's columns for one conversation's rows after damage: (turn, role, text)."""
    seen, faults, kinds = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
        if fault:
            kinds[fault] += 1
    cost, audit = cheapest([(role[:1], fault) for (_, role, _), fault in zip(rows, faults)])
    out, at, state = [], 0, ""
    for k, edit in enumerate(audit):
        new = "u" if (state, "u") in NEXT else "a"
        if edit == "I":
            out.append(("user" if new == "u" else "assistant") + ":")
        else:
            _, role, text = rows[at]
            at += 1
            if edit == "D":
                continue
            role = role if edit == "K" else "user" if new == "u" else "assistant"
            new = role[:1]
            out.append(f"{role}:{text}")
        state = new
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (gaps, *kinds.values(), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def expected(rows):
    """{conv_id: columns} of (conv_id, turn, role, text) rows, damaged as the query damages them."""
    convs: dict = {}
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        held = convs.setdefault(conv, [])
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if case == 0:
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        held += [(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest())
    return {conv: by_hand(sorted(held, key=order)) for conv, held in convs.items()}


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_query_on_the_given_table(spark, sf_dir):
    want = expected([tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()])
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in queries.op12_conversation_repair(spark, sf_dir).collect()}
    assert got == want and any(set("DIR") & set(row[6]) for row in got.values())


SCHEMA = "conv_id bigint, turn bigint, role string, text string, row int, place string, edit int, fault int, digest string"


def written(spark, tmp_path, rows):
    frame = spark.createDataFrame([(*r, 1, "p", 2, 3, "d") for r in rows], SCHEMA)
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def test_query_on_odd_rows(spark, tmp_path):
    dice = random.Random(9)
    texts = ["", None, "  \t", "Yes.", "no end", "What? ", "Ha!\n", "é ", "z" * 200_000 + "."]
    rows = [
        (dice.choice([None, 1, 2, 3, 4, 5]), dice.choice([None, *range(8), 90]), dice.choice(["user", "assistant", "system", "tool", "", None]), dice.choice(texts))
        for _ in range(120)
    ]
    rows += [(77, k, "user" if k % 2 else "assistant", f"line {k}.") for k in range(400)]
    rows += [(k, 0, "user", "Alone.") for k in range(100, 180)]  # some have no row after damage
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in queries.op12_conversation_repair(spark, written(spark, tmp_path, rows)).collect()}
    want = expected(rows)
    assert got == want
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert empty in want.values()


def test_edits_are_a_repaired_conversation(spark):
    rows = [(1, 0, "system", "Rules."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (1, 3, "user", "cut"), (1, 4, "tool", "Answer.")]
    found = cr.repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).orderBy("place").collect()
    assert [(r.edit, r.turn, r.fault, r.role) for r in found] == [
        ("K", 0, None, "system"), ("I", None, None, "user"), ("K", 1, None, "assistant"), ("D", 2, "duplicate", None), ("K", 3, "truncated", "user"), ("R", 4, None, "assistant")
    ]
    assert [r.text for r in found if r.edit != "D"] == ["Rules.", "", "Hello.", "cut", "Answer."]


def test_none(spark):
    convs = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert cr.repair(convs).collect() == [] and cr.account(cr.repair(convs)).collect() == []
