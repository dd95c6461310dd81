"""Texts that differ by white space at their ends are one duplicate cluster."""

from shardwright.llm import packing

from test_text_operators import docs


def test_final_newline_is_the_same_cluster(spark):
    got = packing.pack(docs(spark, [(1, "x y"), (2, "X y\n"), (3, "\tx  y "), (4, "x z")])).collect()
    by_id = {g.doc_id: g for g in got}
    assert by_id[1].cluster == by_id[2].cluster == by_id[3].cluster != by_id[4].cluster
    assert len({by_id[k].bin_id for k in (1, 2, 3)}) == 3
