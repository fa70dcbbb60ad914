"""New edges are joined to known components without going through the old edges again."""

import random

from talktide.llm import components as module
from talktide.llm.common import scratch_table
from talktide.llm.components import components, merged


def test_merged_is_the_components_of_all_edges(spark, monkeypatch):
    draw = random.Random(4)
    frame = lambda edges: spark.createDataFrame(edges, "a long, b long")
    rows = lambda df: sorted(map(tuple, df.collect()))
    old = [(draw.randrange(-90, 90), draw.randrange(-90, 90)) for _ in range(60)] + [(1000 + i, 1001 + i) for i in range(40)]
    new = [(draw.randrange(-150, 150), draw.randrange(-150, 150)) for _ in range(30)] + [(1020, -149), (500, 501), (501, 502), (1000, 1040), (7, 7)]
    known, want = scratch_table(components(frame(old))), rows(components(frame(old + new)))
    sizes, plain = [], module.components

    def seen(edges):
        sizes.append(edges.count())
        return plain(edges)

    monkeypatch.setattr(module, "components", seen)
    assert rows(merged(known, frame(new))) == want
    assert sizes == [len(new)]
    assert rows(merged(known, frame([]))) == rows(known)
    assert rows(merged(scratch_table(known.limit(0)), frame(old))) == rows(known)
