"""Open reading frames on six frames, through the origin of circular molecules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nt import reverse_complement, translate_codons


def open_reading_frames(docs: DataFrame, least_codons: int = 30) -> DataFrame:
    """(doc_id, strand, frame, start0, length, wraps, protein): from the first ATG after a stop to the next stop, stop included.

    docs (doc_id, topology, seq, n). A circular molecule is read once more from its origin; starts beyond it are left out. start0 is
    the first base on the forward strand's coordinates of what the frame covers. A frame that no stop ends gives none.
    """
    s = docs.select("doc_id", "n", "topology", F.explode(F.array(F.struct(F.lit(1).cast("long").alias("strand"), F.col("seq").alias("x")), F.struct(F.lit(-1).cast("long").alias("strand"), reverse_complement(F.col("seq")).alias("x")))).alias("p"))
    s = s.select("doc_id", "n", "topology", "p.strand", F.when(F.col("topology") == "circular", F.concat("p.x", F.substr("p.x", F.lit(1), (F.col("n") - 1).cast("int")))).otherwise(F.col("p.x")).alias("hay"))
    s = s.withColumn("frame", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    s = s.withColumn("parts", F.split(translate_codons(F.substr("hay", F.col("frame"))), "[*]", -1)).drop("hay")
    # parts between stops, with the codon each begins at; the last one has no stop
    step = lambda acc, t: F.struct((acc["at"] + F.length(t) + 1).alias("at"), F.array_append(acc["all"], acc["at"]).alias("all"))
    begins = F.aggregate("parts", F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), step, lambda acc: acc["all"])
    zipped = F.slice(F.arrays_zip("parts", begins.alias("begin")), 1, F.size("parts") - 1)
    o = s.withColumn("o", F.explode(zipped)).withColumn("m", F.instr("o.parts", "M")).filter("m > 0")
    o = o.withColumn("protein", F.substr("o.parts", F.col("m"))).withColumn("first", ((F.col("o.begin") + F.col("m") - 1) * 3 + F.col("frame") - 1).cast("long"))
    o = o.withColumn("length", ((F.length("protein") + 1) * 3).cast("long")).filter((F.length("protein") >= least_codons) & (F.col("first") < F.col("n")) & (F.col("length") <= F.col("n")))
    start = F.when(F.col("strand") == 1, F.col("first")).otherwise(F.pmod(F.col("n") - F.col("first") - F.col("length"), F.col("n")))
    return o.select("doc_id", "strand", F.col("frame").cast("long").alias("frame"), start.alias("start0"), "length", (start + F.col("length") > F.col("n")).alias("wraps"), "protein")
