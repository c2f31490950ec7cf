import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracemill.operators import features, lookup, matching, mining, sequences, templates
from tracemill.session import materialise, stored
from tracemill.sources import logs

# Six sample lines of the public block storage log format, three shapes, two blocks.
LINES = [
    "081109 203518 143 INFO dfs.DataNode$DataXceiver: Receiving block blk_123 src: /10.250.19.102:54106 dest: /10.250.19.102:50010",
    "081109 203519 145 INFO dfs.DataNode$PacketResponder: PacketResponder 1 for block blk_123 terminating",
    "081109 203519 147 INFO dfs.DataNode$PacketResponder: Received block blk_123 of size 91178 from /10.250.14.224",
    "081109 203520 142 INFO dfs.DataNode$DataXceiver: Receiving block blk_456 src: /10.251.215.16:55695 dest: /10.251.215.16:50010",
    "081109 203521 145 INFO dfs.DataNode$PacketResponder: PacketResponder 2 for block blk_456 terminating",
    "081109 203521 148 INFO dfs.DataNode$PacketResponder: Received block blk_456 of size 233217 from /10.250.19.102",
]
HEADER = r"\d{6}\s+\d{6}\s+\d+\s+(INFO|WARN|ERROR|FATAL)\s+[\w\$\.]+:\s+(.+)"


def parsed(spark, lines, pattern=None, masks=()):
    raw = spark.createDataFrame([(k, line) for k, line in enumerate(lines, 1)], "line_id BIGINT, raw STRING")
    return logs.parse(raw, pattern, masks)


def test_six_lines_end_to_end(spark):
    mined = mining.mine(parsed(spark, LINES, HEADER))
    assert [r.event_id for r in mined.orderBy("line_id").collect()] == ["E1", "E2", "E3", "E1", "E2", "E3"]
    shown = {r.event_id: (r.event_template, r.occurrence_count) for r in templates.counts(mined).collect()}
    assert shown == {
        "E1": ("Receiving block <*> src: <*> dest: <*>", 2),
        "E2": ("PacketResponder <*> for block <*> terminating", 2),
        "E3": ("Received block <*> of size <*> from <*>", 2),
    }
    seqs = sequences.build(mined, "block_id", block_id_regex=r"(blk_\d+)")
    rows = {r.seq_id: (r.events, r.label, r.length) for r in seqs.collect()}
    assert rows == {b: (["E1", "E2", "E3"], 0, 3) for b in ("blk_123", "blk_456")}
    vocab = features.vocabulary(seqs)
    assert {r.event: r.idx for r in vocab.collect()} == {"<PAD>": 0, "E1": 1, "E2": 2, "E3": 3}
    assert [r.ids for r in features.padded(seqs, vocab).collect()] == [[1, 2, 3]] * 2
    assert [r.counts for r in features.occurrence_dense(seqs, vocab).collect()] == [[0, 1, 1, 1]] * 2
    stat = features.statistics(seqs).first()
    assert stat.entropy == pytest.approx(1.58496, abs=1e-5)
    assert (stat.seq_length, stat.unique_events, stat.max_event_freq, stat.diversity) == (3, 3, 1, 1.0)
    assert stat.repetition_rate == pytest.approx(1 / 3)


def check_invariants(rows):
    """Each line has its template's length and agrees with it outside wildcards."""
    for r in rows:
        words, shape = r.masked.split(), r.event_template.split()
        assert len(words) == len(shape)
        assert all(t in ("<*>", w) for w, t in zip(words, shape))


def noisy_lines(n, seed=0):
    rnd = random.Random(seed)
    shapes = ["user {} logged in from {} at node {}", "disk {} failed with code {} on {}", "job {} done"]
    return [rnd.choice(shapes).format(*[rnd.randrange(10**6) for _ in range(3)]) for _ in range(n)] + [
        "".join(rnd.choice("abcdefgh") for _ in range(12)) for _ in range(n // 4)
    ]


@pytest.mark.parametrize("tiers", [(None,), (2, 5, None)])
def test_mining_finds_the_shapes_in_any_rounds(spark, tiers, monkeypatch):
    monkeypatch.setattr(mining, "TIERS", tiers)
    lines = noisy_lines(300)
    result = mining.mine_messages(parsed(spark, lines).repartition(5)).collect()
    check_invariants(result)
    assert sum(r.n for r in result) == len(lines)
    shapes = Counter(r.event_template for r in result)
    assert {s for s in shapes if " " in s} == {
        "user <*> logged in from <*> at node <*>", "disk <*> failed with code <*> on <*>", "job <*> done"
    }
    # Words that resemble nothing stay templates of their own.
    assert sum(1 for s in shapes if " " not in s) == 75


def brute_most_similar(rows, sim_th):
    """{id: up} of (leaf, size, [(n, at, key)], m, id) rows, by comparing all pairs of a leaf."""
    out = {}
    for leaf, size, items, m, i in rows:
        keys, best = [k for _, _, k in sorted(items)], None
        for leaf2, _, items2, m2, j in rows:
            if leaf2 == leaf and (-m2, j) < (-m, i):
                shared = [r for r, k in enumerate(keys) if k in {k for _, _, k in items2}]
                if len(shared) >= sim_th * size:
                    new = (-len(shared), min(shared, default=-1), -m2, j)
                    best = new if best is None else min(best, new)
        if best:
            out[i] = best[3]
    return out


@pytest.mark.parametrize("tiers", [(None,), (3, 8, None), (1, 2, 3, 4, 6, 9, None)])
def test_every_signature_finds_its_most_similar(spark, tiers, monkeypatch):
    """Signatures of several lengths over tokens of all frequencies, against all pairs."""
    monkeypatch.setattr(mining, "TIERS", tiers)
    rnd = random.Random(len(tiers))
    drawn = {}
    for k in range(300):
        size = rnd.choice([3, 5, 8, 12])
        tokens = [None if rnd.random() < 0.15 else min(int(rnd.expovariate(0.25)), 20) for _ in range(size)]
        drawn.setdefault((f"leaf {size}", size, tuple(tokens)), (rnd.randrange(1, 6), k))
    n = Counter((leaf, at, t) for leaf, _, tokens in drawn for at, t in enumerate(tokens) if t is not None)
    numbers = {key: i for i, key in enumerate(sorted(n))}
    rows = [
        (leaf, size, sorted((n[leaf, at, t], at, numbers[leaf, at, t]) for at, t in enumerate(tokens) if t is not None), m, k)
        for (leaf, size, tokens), (m, k) in drawn.items()
    ]
    df = spark.createDataFrame(rows, "leaf string, size int, items array<struct<n:long,at:int,key:long>>, m long, id long").cache()
    for sim_th in (0.0, 0.3, 0.5, 0.8):
        got = {r.id: r.up for r in mining._most_similar(df, sim_th).collect()}
        assert got == brute_most_similar(rows, sim_th), sim_th


def test_rare_signatures_of_a_large_leaf_join(spark):
    """1,200 frequent signatures that resemble nothing stand before two rare ones that are alike."""
    shape = [f"a{k // 100} b{k % 100} x{k} y{k} z{k} u{k} v{k} w{k}" for k in range(1200)]
    lines = [x for x in shape for _ in (0, 1)] + ["p q r s a b c d", "p q r t e f g h"]
    rows = spark.createDataFrame([(k + 1, x) for k, x in enumerate(lines)], "line_id BIGINT, raw STRING")
    got = {r.masked: r.event_template for r in mining.mine_messages(logs.parse(rows), sim_th=0.375).collect()}
    assert got[lines[-1]] == got[lines[-2]] == "p q r <*> <*> <*> <*> <*>"


def test_mining_a_leaf_of_many_messages(spark):
    """One leaf of 100,000 messages: one frequent template, one rare one, and two parameters with recurring values."""
    ids = spark.range(100_000)
    value = lambda k, n: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)).cast("string")
    often = F.concat_ws(" ", F.lit("job"), value(1, 10**9), F.lit("moved from"), value(2, 50), F.lit("to"), value(3, 5000))
    rare = F.concat_ws(" ", F.lit("job"), value(1, 10**9), F.lit("was stopped by"), value(2, 50), F.lit("now"))
    lines = ids.select(F.col("id").alias("line_id"), F.when(F.col("id") % 500 == 7, rare).otherwise(often).alias("raw"))
    got = mining.mine_messages(logs.parse(lines)).groupBy("event_template").agg(F.sum("n").alias("n")).collect()
    assert {r.event_template: r.n for r in got} == {"job <*> moved from <*> to <*>": 99_800, "job <*> was stopped by <*> now": 200}


def test_mining_parts_tokens_in_one_place(spark):
    lines = ["a b\x1cc d", "a x d", "a y d", "a\x1fb", "\u2003a  b"]
    got = {r.masked: r.event_template for r in mining.mine_messages(parsed(spark, lines)).collect()}
    assert got["a x d"] == got["a y d"] == "a <*> d" and len(got) == 5


@pytest.mark.parametrize("sim_th", [0.0, 0.4])
def test_leaves_are_compared_within_a_task_or_across_tasks(spark, sim_th, monkeypatch):
    """Leaves of any size have the same clusters in one task, without a row for each token, as by joins, and as some by either."""
    rnd = random.Random(8)
    words = [f"{chr(97 + k % 26)}{k // 26}" for k in range(40)] + ["<*>"]
    lines = noisy_lines(100, seed=5) + [" ".join(["w", *[words[min(int(rnd.expovariate(0.15)), 40)] for _ in range(rnd.choice([2, 4, 7]))]]) for _ in range(500)] + ["", None]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lines, 1)], "line_id BIGINT, raw STRING")
    found = {}
    for most in (0, 600, 10**9):
        monkeypatch.setattr(mining, "LEAF_TOKENS", most, raising=False)
        monkeypatch.setattr(mining, "GROUP_TOKENS", 700, raising=False)
        if most == 10**9:
            monkeypatch.setattr(mining, "_constants", lambda placed: pytest.fail("tokens became rows"))
        mined = mining.mine(logs.parse(rows), sim_th=sim_th).collect()
        found[most] = sorted((r.line_id, r.event_id or "", r.event_template or "") for r in mined if r.raw != "")
    assert len(found[0]) == len(lines) - 1 and len({e for _, e, _ in found[0]}) > 25
    assert found[0] == found[600] == found[10**9]


def test_lines_must_be_unique(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, "c d e")], "line_id BIGINT, raw STRING")
    with pytest.raises(ValueError, match="not unique"):
        mining.mine_messages(logs.parse(rows))


def test_mining_does_not_depend_on_partitioning(spark):
    lines = noisy_lines(200, seed=4)
    first = {r.masked: (r.event_id, r.event_template) for r in mining.mine_messages(parsed(spark, lines).repartition(1)).collect()}
    again = {r.masked: (r.event_id, r.event_template) for r in mining.mine_messages(parsed(spark, lines).repartition(9)).collect()}
    assert first == again


def test_similarity_threshold_and_order_of_lines(spark):
    lines = ["a b c d e", "a b x y z", "a q r s t", "a b c d f"]
    loose = {r.masked: r.event_template for r in mining.mine_messages(parsed(spark, lines), sim_th=0.4).collect()}
    assert loose == {"a b c d e": "a b <*> <*> <*>", "a b x y z": "a b <*> <*> <*>", "a b c d f": "a b <*> <*> <*>", "a q r s t": "a q r s t"}
    strict = {r.masked: r.event_template for r in mining.mine_messages(parsed(spark, lines), sim_th=0.7).collect()}
    assert strict["a b c d e"] == strict["a b c d f"] == "a b c d <*>" and strict["a b x y z"] == "a b x y z"


def test_prefixes_beyond_max_children_share_a_leaf(spark):
    lines = [f"w{chr(97 + k)} common words here" for k in range(6)] * 2
    few = mining.mine_messages(parsed(spark, lines), max_children=1).select("event_template").distinct().count()
    many = mining.mine_messages(parsed(spark, lines)).select("event_template").distinct().count()
    assert (few, many) == (2, 6)


def test_rare_and_noise_templates_become_unknown(spark):
    names = [("E1", "ok message", 6), ("E2", "rare message", 4), ("E3", "five times", 5), ("E4", "r00=0x1f", 9), ("E5", "0x0 1f", 9), ("E6", "12 3.4", 9), ("E7", "fpr1=0xA tail", 7), ("E8", "esr=0x1", 7)]
    rows = [(e, t) for e, t, n in names for _ in range(n)]
    df = spark.createDataFrame(rows, "event_id STRING, event_template STRING")
    table = templates.counts(df)
    kept = templates.filter_templates(table, 5)
    assert {r.event_id for r in kept.collect()} == {"E1", "E3"}
    mapped = {r.event_id: r.n for r in templates.to_unk(df, kept).groupBy("event_id").agg(F.count("*").alias("n")).collect()}
    assert mapped == {"E1": 6, "E3": 5, "<UNK>": len(rows) - 11}
    assert {r.event_template for r in templates.to_unk(df, kept).where("event_id = '<UNK>'").collect()} == {"<UNK>"}
    row = templates.coverage(table, 5).first()
    assert (row.kept_templates, row.rare_templates, row.noise_templates) == (2, 1, 5)
    assert row.coverage_percent == pytest.approx(1100 / len(rows))
    assert templates.filter_templates(table, 1, remove_noise=False).count() == 8


def test_catalogue_matching_prefers_literal_text(spark):
    catalogue = spark.createDataFrame(
        [("E1", "[*]Received block[*]of size[*]from[*]"), ("E2", "[*]Received block[*]"), ("E3", "a.b (c) <*>"), ("E4", "never")],
        "event_id STRING, event_template STRING",
    )
    lines = ["Received block blk_1 of size 3 from x", "x Received block y", "a.b  (c) d", "axb (c) d", "other"]
    matched = matching.match(parsed(spark, lines), catalogue)
    assert [r.event_id for r in matched.orderBy("line_id").collect()] == ["E1", "E2", "E3", "<UNK>", "<UNK>"]
    stats = {r.event_id: r.occurrence_count for r in templates.match_statistics(matched, catalogue).collect()}
    assert stats == {"E1": 1, "E2": 1, "E3": 1, "E4": 0}


def test_catalogues_larger_than_one_pass(spark, monkeypatch):
    monkeypatch.setattr(matching, "TEMPLATES_PER_PASS", 3)
    rows = [(f"E{k}", f"word{k:02d} <*>") for k in range(10)]
    catalogue = spark.createDataFrame(rows, "event_id STRING, event_template STRING")
    lines = [f"word{k:02d} value" for k in range(10)] + ["word99 value"]
    got = [r.event_id for r in matching.match(parsed(spark, lines), catalogue).orderBy("line_id").collect()]
    assert got == [f"E{k}" for k in range(10)] + ["<UNK>"]


def test_indexed_matching_equals_testing_one_by_one(spark):
    rnd = random.Random(3)
    words = ["user", "disk", "node", "of", "in", "(a)", "x.y", "é"]
    shapes = {" ".join(rnd.choice([*words, "<*>", "[*]", "r<*>=0x<*>"]) for _ in range(rnd.randrange(1, 6))) for _ in range(150)} | {"<*>of<*>", "in <*>  of"}
    catalogue = spark.createDataFrame([(f"E{k}", s) for k, s in enumerate(sorted(shapes))], "event_id STRING, event_template STRING")
    lines = [" ".join(rnd.choice([*words, "r1=0x2", "7"]) for _ in range(rnd.randrange(1, 7))) for _ in range(300)] + ["", "in 3 of", "in  3\tof"]
    messages = parsed(spark, sorted(set(lines)))
    one, two = (find(messages, catalogue).select("masked", "event_id", "event_template") for find in (matching.match_messages, matching.match_indexed))
    assert sorted(one.collect()) == sorted(two.collect())


def test_lookup_with_hot_keys(spark):
    big = spark.range(2000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("key"))
    small = materialise(big.groupBy("key").agg(F.count("*").alias("n")).withColumn("value", F.upper("key")).where("key <> 'k1'"))
    rows = lookup.spread_lookup(big, small, "key", "n", "id").collect()
    assert len(rows) == 2000
    assert all(r.value == (None if r.key == "k1" else r.key.upper()) for r in rows)
    assert sorted(rows) == sorted(lookup.lookup(big, small, "key", "n", "id").select("id", "key", "value").collect())


def test_template_text_and_ids(spark):
    names = spark.createDataFrame([("E1", "x" * 61), ("E2", "y" * 60)], "event_id STRING, event_template STRING")
    events = spark.createDataFrame([("E1",), ("E9",)], "event_id STRING")
    assert {r.event_id: r.event_template for r in templates.template_text(events, names).collect()} == {"E1": "x" * 61, "E9": "Unknown"}
    table = names.withColumn("occurrence_count", F.when(F.col("event_id") == "E1", 3).otherwise(1))
    ends = templates.top_and_bottom(table, 1).collect()
    assert [(r.side, r.event_id, r.share_percent) for r in ends] == [("top", "E1", 75.0), ("bottom", "E2", 25.0)]
    assert ends[0].template_short == "x" * 60 + "..." and ends[1].template_short == "y" * 60


def test_messages_of_a_large_catalogue_are_not_broadcast(spark):
    rows = [(f"A{k}", f"r<*>x{k:08d}") for k in range(30)] + [(f"D{k}", "r<*>07") for k in range(30)] + [("W", "job <*> done"), ("V", "job  <*> done")]
    known = spark.createDataFrame(rows, "event_id string, event_template string")
    texts = [f"r5=0x{k:08d}" for k in range(0, 60, 3)] + ["r1 07", "job 7 done", "job 7 failed", "x"]
    messages = stored(spark.createDataFrame([(t,) for t in texts], "masked string"))
    found = matching.match_indexed(messages, known)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "Join [_key#" in line and "Inner" in line]
    assert joins and not [line for line in joins if "Broadcast" in line]
    expected = {r.masked: (r.event_id, r.event_template) for r in matching.match_messages(messages, known).collect()}
    assert {r.masked: (r.event_id, r.event_template) for r in found.collect()} == expected
    assert expected["r1 07"][0] == "D0" and expected["job 7 done"][0] == "V" and expected["r5=0x00000003"][0] == "A3"
