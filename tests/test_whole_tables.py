"""The recall and trace-back queries about every plot and every customer, against plain Python."""

import __spark_entry__ as entry


def test_every_plot_and_customer(spark, tmp_path):
    d, queries = str(tmp_path), entry.queries()

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")

    write("part", [(k, f"Brand#{11 * (k % 3 + 1)}", k) for k in range(1, 9)], "p_partkey long, p_brand string, p_size int")
    write("customer", [(k, k % 2, "BUILDING" if k == 1 else "MACHINERY") for k in range(1, 5)], "c_custkey long, c_nationkey long, c_mktsegment string")
    write("nation", [(0, 0), (1, 0)], "n_nationkey long, n_regionkey long")
    write("orders", [(k, k % 4 + 1, "O") for k in range(1, 7)], "o_orderkey long, o_custkey long, o_orderstatus string")
    items = [(o, (o * 3 + i) % 8 + 1, i) for o in range(1, 7) for i in range(2)]
    write("lineitem", items, "l_orderkey long, l_partkey long, l_suppkey long")

    plot, lot, buyer = "P{:010d}".format, "O{:010d}".format, "C{:010d}".format
    # Parts p and p - p % 3 are the same unless 4 divides p.
    same = {(p, p) for p in range(1, 9)} | {x for p in range(1, 9) if p % 3 and p % 4 for x in ((p, p - p % 3), (p - p % 3, p))}
    same = {(a, b) for a, b in same if a}
    rows = lambda name: {tuple(r) for r in queries[name](spark, d).collect()}
    assert rows("equivalence_set_all") == {(plot(a), plot(b)) for a, b in same}
    assert rows("reverse_lookup_all") == {(plot(a), lot(o)) for a, b in same for o, p, _ in items if p == b}
    direct = rows("trace_forward_direct_all")
    assert {r[:2] for r in direct if r[2] == "match"} == {(plot(p), lot(o)) for o, p, _ in items}
    assert rows("trace_back_closure_all") == {(buyer(o % 4 + 1), plot(p)) for o, p, _ in items}
    assert {r[0] for r in rows("trace_back_summary_all")} == {buyer(k) for k in range(1, 5)}
    assert rows("trace_back_closure") < rows("trace_back_closure_all") and rows("equivalence_set") < rows("equivalence_set_all")
