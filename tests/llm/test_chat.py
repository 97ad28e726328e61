import itertools
import random

import pytest

from notelens.llm import chat as op
from notelens.llm.chat_queries import op6_chat_repair

SF = "/root/testdata/sf0.01"
LEGAL = [seq for n in range(12) for seq in itertools.product("ua", repeat=n) if seq[:1] in ((), ("u",)) and all(a != b for a, b in zip(seq, seq[1:]))]
LEGAL = [s for s in LEGAL if not s or s[-1] == "a"]
LEGAL = {tuple({"u": op.USER, "a": op.ASSISTANT}[x] for x in s) for s in LEGAL}
LEGAL |= {(op.SYSTEM, *s) for s in LEGAL if s}


def plain_cost(roles):
    """The least cost over all legal message sequences, by matching turns to messages in every way."""
    best = 1 << 60

    def match(target, k, at, cost, filled):
        """``at``: messages begun; ``filled``: whether a turn stands in the last one."""
        nonlocal best
        if cost >= best:
            return
        if k == len(roles):
            best = min(best, cost + op.INSERT * (len(target) - at))
            return
        role = roles[k]
        if at:  # merge into the last message begun
            match(target, k + 1, at, cost + (op.UNKNOWN if role == 0 else op.MERGE if target[at - 1] == role else op.MERGE_OTHER), True)
        for skip in range(len(target) - at):
            q = target[at + skip]
            match(target, k + 1, at + skip + 1, cost + op.INSERT * skip + (0 if q == role else op.UNKNOWN if role == 0 else op.RELABEL), True)

    for target in LEGAL:
        if roles and target and len(target) <= 2 * len(roles) + 2:
            match(target, 0, 0, 0, False)
    return best if roles else 0


def messages(rendered):
    return [m.split("\n", 1) for m in rendered.replace("<|im_end|>\n", "").split("<|im_start|>")[1:]]


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_least_cost_equals_listing(n):
    for roles in itertools.product(range(4), repeat=n):
        states, cost = op.cuts([op.matrix(list(roles))])
        assert cost == plain_cost(list(roles)), roles
        text, names, count = op.render([(r, str(k)) for k, r in enumerate(roles)], states[0], states[1], True)
        found = tuple(op.ROLES[m[0]] for m in messages(text))
        assert found in LEGAL and len(found) == count


def test_stretches_give_the_same_cost_and_texts(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None, " User "]), f"text {t}") for c in range(30) for t in range(rng.randint(1, 40))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {r.conv_id: r for r in op.repair(turns).collect()}
    cut = {}
    for r in op.repair(turns, stretch=3).collect():
        cut.setdefault(r.conv_id, []).append(r)
    assert set(whole) == set(cut) == set(range(30))
    for c, parts in cut.items():
        parts.sort(key=lambda r: r.part)
        assert {r.cost for r in parts} == {whole[c].cost} and sum(r.n_turns for r in parts) == whole[c].n_turns
        text = "".join(r.rendered for r in parts)
        assert tuple(op.ROLES[m[0]] for m in messages(text))[-1] == op.ASSISTANT
        said = [line for _, body in messages(text) for line in body.split("\n") if line]
        assert said == [f"text {t}" for t in range(whole[c].n_turns)]


def test_query(spark):
    rows = op6_chat_repair(spark, SF).collect()
    turns = {}
    for t in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns.setdefault(t.conv_id, []).append((t.turn, t.role, t.text))
    assert {r.conv_id for r in rows} == set(turns)
    for r in rows:
        own = sorted(turns[r.conv_id])
        roles = [op.role_code(t[1]) for t in own]
        if r.cost == 0:
            assert r.rendered == "".join(f"<|im_start|>{t[1]}\n{t[2]}<|im_end|>\n" for t in own)
        if len(roles) <= 3:
            assert r.cost == plain_cost(roles)


def test_odd_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "SYSTEM", None), (None, 5, None, "x"), (None, 5, None, "y"), (2, 0, "user", "z" * 100_000)]
    turns = spark.createDataFrame([(*r, "extra", 7) for r in rows], "conv_id long, turn long, role string, text string, part string, cost int")
    got = {(r.conv_id, r.part): r for r in op.repair(turns).collect()}
    assert "".join(got[1, p].rendered for p in (0, 1)) == "<|im_start|>system\n<|im_end|>\n<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert messages(got[None, 0].rendered) == [["user", "x"], ["assistant", "y"]] and got[None, 0].cost == 2 * op.UNKNOWN
    assert got[2, 0].n_messages == 2 and "z" * 100_000 in got[2, 0].rendered
    assert op.repair(turns.limit(0)).count() == 0


@pytest.mark.parametrize("wide", [op.WIDE, 16])
def test_stretches_are_bounded_under_null_and_tied_turns(spark, wide):
    rng = random.Random(3)
    kinds = ["user", "assistant", "tool", None]
    rows = [(None, None, rng.choice(kinds), f"{'same start ' * 30}{k % 150}") for k in range(200)]
    rows += [(7, 1, rng.choice(kinds), f"text {k}") for k in range(90)] + [(7, 40, "user", None), (7, 40, "user", ""), (8, 0, "user", "hello"), (8, 1, "assistant", "you")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {}
    for r in op.repair(turns, stretch=8, wide=wide).collect():
        got.setdefault(r.conv_id, []).append(r)
    order = lambda x: tuple((v is not None, v) for v in x)
    for conv in (None, 7, 8):
        own = sorted({r[1:] for r in rows if r[0] == conv}, key=order)
        states, cost = op.cuts([op.matrix([op.role_code(r) for _, r, _ in own])])
        parts = sorted(got[conv], key=lambda r: r.part)
        assert [r.part for r in parts] == list(range(len(parts)))
        assert max(r.n_turns for r in parts) <= 8 and sum(r.n_turns for r in parts) == len(own) and {r.cost for r in parts} == {cost}
        said = [line for _, body in messages("".join(r.rendered for r in parts)) for line in body.split("\n") if line]
        assert said == [t for _, _, t in own if t]
