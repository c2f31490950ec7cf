from collections import Counter, defaultdict

from tracemill.sources.tables import as_sequences


def seqs_of(spark, lists):
    rows = [(f"s{k}", list(e), 0) for k, e in enumerate(lists)]
    return as_sequences(spark.createDataFrame(rows, "seq_id STRING, events ARRAY<STRING>, label INT"))


def brute_detect(train, events, order, k):
    """Any event outside the k most frequent successors of the longest known context, and how many."""
    counts = defaultdict(Counter)
    for seq in train:
        for i in range(1, len(seq)):
            for h in range(0, min(order, i) + 1):
                counts[tuple(seq[i - h : i])][seq[i]] += 1
    missed = 0
    for i in range(1, len(events)):
        h = next(h for h in range(min(order, i), -1, -1) if h == 0 or tuple(events[i - h : i]) in counts)
        context = counts[tuple(events[i - h : i])]
        best = sorted(context, key=lambda e: (-context[e], e))[:k]
        missed += events[i] not in best
    return int(missed > 0), missed
