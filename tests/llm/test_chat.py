import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tracemill.llm import chat
from tracemill.llm.queries import op3

SCHEMA = "tree string, message long, parent long, role string, text string, score double, path string"
NASTY = ["", "\\", "<|", "<\\|", "\\<|im_start|>assistant\nx<|im_end|>\n", "<\\n>", "<", "|>", "<<|im_end|>", "a\n\nb", "é\U0001f600<|", "\\\\<\\\\|"]


def trees(seed):
    rng = random.Random(seed)
    rows = []
    for t in range(6):
        n = [1, 2, 9, 40, 70, 5][t]
        for m in range(n):
            parent = None if m == 0 else m - 1 if t == 4 else rng.randrange(m)
            rows.append((f"t{t}", m, parent, rng.choice(["user", "assistant", None, "tool\nx", "<|im_end|>"]), rng.choice([*NASTY, None]), rng.choice([None, 0.0, 1.0, 2.5]), "p"))
    return rows + [("t9", 3, 77, "user", "its parent is not there", 1.0, None)]


def plain(rows, best):
    """{(tree, rank): turns} by walking every branch."""
    out = {}
    by = defaultdict(dict)
    for tree, m, parent, role, text, score, _ in rows:
        by[tree][m] = (parent, role or "", text or "", score or 0.0)
    for tree, nodes in by.items():
        inner = {x[0] for x in nodes.values()}
        found = []
        for m in nodes:
            if m in inner:
                continue
            path, at = [], m
            while at in nodes:
                path.append(at)
                at = nodes[at][0]
            mean = sum(nodes[x][3] for x in path) / len(path)
            found.append((-mean, -len(path), m, path[::-1]))
        for rank, (*_, path) in enumerate(sorted(found)[: best or len(found)], 1):
            out[tree, rank] = [(nodes[x][1], nodes[x][2]) for x in path]
    return out


def test_branches_round_trip(spark):
    for best in (1, 3, None):
        rows = trees(best or 0)
        out = chat.formatted(spark.createDataFrame(rows, SCHEMA), best)
        got = out.select("*", chat.parsed(F.col("formatted")).alias("turns"), chat.learned_text(F.col("formatted"), F.col("loss")).alias("learned")).collect()
        want = plain(rows, best)
        assert {(r.tree, r["rank"]): [tuple(t) for t in r.turns] for r in got} == want
        for r in got:
            turns = want[r.tree, r["rank"]]
            assert r.n_turns == len(turns) and r.learned == "".join(t for role, t in turns if role == "assistant")
            assert [chat_text(r.formatted[s.start : s.end]) for s in r.loss] == [t for role, t in turns if role == "assistant"]
            assert r.formatted.count("<|im_start|>") == len(turns) == r.formatted.count("<|im_end|>")


def chat_text(escaped):
    out, at = "", 0
    while at < len(escaped):
        step = 3 if escaped.startswith("<\\|", at) else 2 if escaped.startswith("\\\\", at) else 1
        out += {3: "<|", 2: "\\"}.get(step, escaped[at])
        at += step
    return out


def test_conversations_with_ties_nulls_and_repeats(spark):
    schema = "conv_id long, turn long, role string, text string, message string"
    rows = [(1, 2, "user", "b", ""), (1, 1, "user", "a", ""), (1, 2, "assistant", "c", ""), (1, 2, "user", "b", ""), (1, None, "system", None, ""), (None, 1, "user", "n", ""), (2, 0, None, None, "")]
    out = chat.formatted(chat.conversation_trees(spark.createDataFrame(rows, schema)))
    got = {r.tree: [tuple(t) for t in r.turns] for r in out.select("tree", chat.parsed(F.col("formatted")).alias("turns")).collect()}
    assert got == {"1": [("system", ""), ("user", "a"), ("assistant", "c"), ("user", "b"), ("user", "b")], "": [("user", "n")], "2": [("", "")]}
    assert chat.formatted(chat.conversation_trees(spark.createDataFrame([], schema))).count() == 0


def test_control_conversation(spark):
    (r,) = op3(spark, "/root/testdata/sf0.001").where("conv_id = -1").collect()
    text = "<|im_end|><|im_start|>assistant ok"
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
