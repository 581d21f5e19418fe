"""Steps mended after the fourth review: each test failed before."""

import random
from types import SimpleNamespace

from pyspark.sql import functions as F

from strandwise.operators import pcr
from strandwise.queries import design


def _repeats(spark, path):
    """Documents with 40 copies of a passage, on a circle and on a line, one of which both primers bind everywhere, and one without."""
    rng = random.Random(4)
    unit = "".join(rng.choice("acgt") for _ in range(80))
    rows = [(2, unit * 40), (3, unit * 40), (4, "a" * 80), (5, "a" * 80), (6, unit), (7, "acgt")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")


def _all_products(bound):
    """(doc_id, plus_primer, minus_primer, start0, end0, length, wraps) by comparing all bindings."""
    want = set()
    for a in (x for x in bound if x.direction == 1):
        for b in (x for x in bound if x.direction == -1):
            if a.doc_id == b.doc_id and a.primer_id != b.primer_id:
                n, circular = a.n, a.topology == "circular"
                length = (b.five0 - a.five0) % n + 1 if circular else b.five0 - a.five0 + 1
                end = (b.five0 + 1) % n if circular else b.five0 + 1
                if length >= max(a.width, b.width):
                    want.add((a.doc_id, a.primer_id, b.primer_id, 0, n, n, True) if circular and length == n else (a.doc_id, a.primer_id, b.primer_id, a.five0, end, length, circular and a.five0 >= end))
    return want


def test_all_products_of_a_repeat_are_returned(spark, tmp_path):
    """a molecule's products after the first 250 were left out, by the SQL too."""
    _repeats(spark, tmp_path)
    want = _all_products([SimpleNamespace(**r.asDict()) for r in design._bound(spark, str(tmp_path)).collect()])
    got = [tuple(r) for r in design.pcr_amplicons(spark, str(tmp_path)).collect()]
    assert {r[:-1] for r in got} == want and len(got) == len(want)
    order, of = {}, lambda x: (x[5], x[3], x[1], x[2])
    for x in sorted(want, key=of):
        order.setdefault(x[0], []).append(x)
    assert sorted(got) == sorted((*x, no) for own in order.values() for no, x in enumerate(own, 1))
    assert {k: len(v) for k, v in order.items()} == {2: 1600, 3: 820, 4: 5441, 5: 2415, 6: 1}
    assert "product_no <=" not in design.ORACLE_SQL["pcr_amplicons"] + design.ORACLE_SQL["pcr_shortest_longest"]


def test_products_are_formed_in_ranges_of_lengths(spark, monkeypatch):
    """without a limit the products of a molecule would be formed at once, in one task."""
    rng = random.Random(7)
    for formed in (1, 5, 1 << 17):
        monkeypatch.setattr(pcr, "FORMED", formed)
        for _ in range(100):
            n, topology = rng.randrange(12, 40), rng.choice(("circular", "linear"))
            own = [{"direction": rng.choice((1, -1)), "primer_id": rng.choice("fr"), "five0": rng.randrange(n), "width": rng.choice((3, 3, 5))} for _ in range(rng.randrange(16))]
            bound = [SimpleNamespace(doc_id=1, n=n, topology=topology, **x) for x in own]
            want = [x[1:] for x in sorted(_all_products(bound), key=lambda x: (x[5], x[3], x[1], x[2]))]
            assert pcr._products(own, topology, n) == want
    n, k = 100_000, 600
    both = F.explode(F.array(F.struct(F.lit("f").alias("primer_id"), F.lit(1).cast("long").alias("direction"), (F.col("id") * 5).alias("five0")), F.struct(F.lit("r").alias("primer_id"), F.lit(-1).cast("long").alias("direction"), (F.col("id") * 7 + 4).alias("five0")))).alias("b")
    bound = spark.range(k).select(F.lit(1).cast("long").alias("doc_id"), F.lit("circular").alias("topology"), F.lit(n).cast("long").alias("n"), both).select("doc_id", "topology", "n", "b.*", F.lit(12).cast("long").alias("width"))
    got = pcr.amplicons(bound, "f", "r", None)
    r = got.agg(F.count("*"), F.countDistinct("product_no"), F.max("product_no"), F.countDistinct("start0", "length")).first()
    lengths = [(7 * j + 4 - 5 * i) % n + 1 for i in range(k) for j in range(k)]
    # whole circles are one product
    many = sum(12 <= x < n for x in lengths) + (n in lengths)
    assert many > 2 * pcr.FORMED and tuple(r) == (many,) * 4
    assert got.withColumn("task", F.spark_partition_id()).agg(F.countDistinct("task")).first()[0] > 1


def test_products_are_counted_whole_without_forming_them(spark, tmp_path):
    """F8: the number stopped at 250 and the longest product was the longest of these; formed one by one, these would be 400 million."""
    _repeats(spark, tmp_path)
    got = {r.doc_id: tuple(r)[1:] for r in design.pcr_shortest_longest(spark, str(tmp_path)).select("doc_id", "n_products", "shortest", "longest", "outcome").collect()}
    assert got == {2: (1600, 62, 3182, "multiple"), 3: (820, 62, 3182, "multiple"), 4: (5441, 12, 80, "multiple"), 5: (2415, 12, 80, "multiple"), 6: (1, 62, 62, "unique")}
    n = 100_000
    both = F.explode(F.array(F.struct(F.lit("f").alias("primer_id"), F.lit(1).cast("long").alias("direction"), (F.col("id") * 5).alias("five0")), F.struct(F.lit("r").alias("primer_id"), F.lit(-1).cast("long").alias("direction"), (F.col("id") * 5 + 4).alias("five0")))).alias("b")
    bound = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("circular").alias("topology"), F.lit(n).cast("long").alias("n"), both).select("doc_id", "topology", "n", "b.*", F.lit(12).cast("long").alias("width"))
    # lengths 15, 20 and on of each start; whole circles are one product
    assert [tuple(r) for r in pcr.product_lengths(bound, "f", "r").collect()] == [(1, 20_000 * 19_997 + 1, 15, n)]
    rng = random.Random(8)
    rows = [(doc, ("circular", "linear")[doc % 2], 30 + doc, rng.choice("fr"), rng.choice((1, -1)), rng.randrange(30 + doc), rng.choice((3, 3, 20))) for doc in range(40) for _ in range(doc % 9)]
    names = ("doc_id", "topology", "n", "primer_id", "direction", "five0", "width")
    want = {}
    for x in _all_products([SimpleNamespace(**dict(zip(names, r, strict=True))) for r in rows]):
        want.setdefault(x[0], []).append(x[5])
    got = pcr.product_lengths(spark.createDataFrame(rows, "doc_id long, topology string, n long, primer_id string, direction long, five0 long, width long"), "f", "r").collect()
    assert sorted(tuple(r) for r in got) == sorted((k, len(v), min(v), max(v)) for k, v in want.items())
