"""Type IIS parts, ordered assembly, and domestication."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.nt import rc
from ..functions.tables import codons, enzymes


def digest_parts(parts: DataFrame, enzyme: str = "BsaI") -> DataFrame:
    """parts (assembly_id, ord, seq) with left_overhang, right_overhang, body (both overhangs included), error, and body_start0.

    The first forward site and the last reverse site release the body; a further site between them, a missing one, or the wrong
    order is an error.
    """
    e = enzymes(enzyme)[0]
    site, back, top, size = e["recognition"], rc(e["recognition"]), e["top_cut"] if e["top_cut"] is not None else 1, e["overhang_len"] or 4
    w = len(site)
    p = parts.withColumn("f", F.instr("seq", site)).withColumn("r", F.instr(F.reverse("seq"), back[::-1]))
    # 1-based begin of the last reverse site
    p = p.withColumn("r", F.when(F.col("r") > 0, F.length("seq") - F.col("r") - w + 2).otherwise(0))
    a, b = F.col("f") + w + top, F.col("r") - top
    error = (
        F.when(F.col("f") == 0, "MISSING_FORWARD").when(F.col("r") == 0, "MISSING_REVERSE").when(b - a < 2 * size, "WRONG_ORDER")
        .when(F.instr(F.substr("seq", F.col("f") + 1), site) > 0, "INTERNAL_FORWARD").when(F.instr("seq", back) < F.col("r"), "INTERNAL_REVERSE")
    )
    p = p.withColumn("error", error).withColumn("body", F.when(F.col("error").isNull(), F.substr("seq", a, b - a)))
    return p.select(*parts.columns, F.substr("body", F.lit(1), F.lit(size)).alias("left_overhang"), F.right("body", F.lit(size)).alias("right_overhang"), "body", "error", F.when(F.col("error").isNull(), a - 1).cast("long").alias("body_start0"))


def junctions(digested: DataFrame, circular: bool = True) -> DataFrame:
    """(assembly_id, ord, right_overhang, next_overhang, compatible): each part and the one after it; the last meets the first if circular."""
    w = W.partitionBy("assembly_id").orderBy("ord")
    first = F.first("left_overhang").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    follows = F.lead(F.struct("left_overhang")).over(w)
    nxt = F.when(follows.isNotNull(), follows["left_overhang"]).otherwise(first if circular else F.lit(None))
    j = digested.withColumn("last", F.lead("ord").over(w).isNull()).withColumn("next_overhang", nxt)
    j = j if circular else j.filter("not last")
    return j.select("assembly_id", "ord", "right_overhang", "next_overhang", F.coalesce(F.col("right_overhang") == F.col("next_overhang"), F.lit(False)).alias("compatible"))


def assemble(digested: DataFrame, circular: bool = True, size: int = 4) -> DataFrame:
    """(assembly_id, n_parts, n_compatible, sequence): bodies in order, each joint's overhang once; null sequence unless all joints fit."""
    j = junctions(digested, circular)
    # joints that hold before the first that does not
    w = W.partitionBy("assembly_id").orderBy("ord")
    ok = j.withColumn("bad", F.sum(F.when(F.col("compatible"), 0).otherwise(1)).over(w)).groupBy("assembly_id").agg(F.sum(F.when(F.col("bad") == 0, 1).otherwise(0)).alias("n_compatible"), F.count(F.lit(1)).alias("n_joints"))
    last = F.max("ord").over(W.partitionBy("assembly_id"))
    piece = F.when(F.lit(circular) | (F.col("ord") < last), F.expr(f"substring(body, 1, length(body) - {size})")).otherwise(F.col("body"))
    text = digested.withColumn("piece", piece).groupBy("assembly_id").agg(F.array_sort(F.collect_list(F.struct("ord", "piece"))).alias("ps"), F.count(F.lit(1)).alias("n_parts"))
    joined = F.array_join(F.transform("ps", lambda x: x["piece"]), "")
    out = text.join(ok, "assembly_id")
    return out.select("assembly_id", "n_parts", "n_compatible", F.when((F.col("n_joints") == F.col("n_compatible")) & (F.col("n_parts") >= 2), joined).alias("sequence"))


def domesticate_one(seq: str, site: str, rounds: int = 20) -> tuple[str | None, list[int]]:
    """(sequence without the site on either strand, positions changed), or (None, []) if a site can't be removed.

    Each round takes the first forward site, else the first reverse one, and tries its bases from left to right with T, C, A, G: the
    codon must keep its amino acid and no site may arise around it. Outside full codons a base changes to its transition.
    """
    code, back, changed, text = codons(), rc(site), [], seq
    w = len(site)
    for _ in range(rounds):
        at = text.find(site)
        at = at if at >= 0 else text.find(back)
        if at < 0:
            return text, changed
        done = False
        for i in range(at, at + w):
            c = i - i % 3
            full = c + 3 <= len(text)
            options = "TCAG" if full else {"A": "G", "G": "A", "C": "T", "T": "C"}.get(text[i], "")
            for base in options:
                new = text[:i] + base + text[i + 1 :]
                near = new[max(0, i - w + 1) : i + w]
                if base != text[i] and site not in near and back not in near and (not full or code.get(new[c : c + 3]) == code.get(text[c : c + 3])):
                    text, done = new, True
                    changed.append(i)
                    break
            if done:
                break
        if not done:
            return None, []
    return (None, []) if site in text or back in text else (text, changed)


def domesticate(docs: DataFrame, enzyme: str = "BsaI") -> DataFrame:
    """(doc_id, domesticated, positions) of coding sequences docs (doc_id, seq): iterative, so a small helper runs it row by row."""
    site = enzymes(enzyme)[0]["recognition"]

    def run(batches):
        for b in batches:
            got = [domesticate_one(s or "", site) for s in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.list_(pa.int32()))], names=["doc_id", "domesticated", "positions"])

    kind = docs.select("doc_id").dtypes[0][1]
    return docs.select("doc_id", "seq").mapInArrow(run, f"doc_id {kind}, domesticated string, positions array<int>")
