"""FASTA files as a Spark data source, and site search as a table function for SQL."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf

from ..functions.nt import rc, site_class
from ..functions.tables import enzymes


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        """Records as they come: one sequence at a time is in memory."""
        name, parts, no = None, [], 0
        with open(partition.path) as f:
            for line in f:
                line = line.strip()
                if line.startswith(">"):
                    if name is not None:
                        yield (partition.path, no, name, "".join(parts))
                    no, name, parts = no + 1, (line[1:].split() or [""])[0], []
                elif line:
                    name = name if name is not None else ""
                    parts.append(line.upper())
        if name is not None:
            yield (partition.path, no, name, "".join(parts))


class FastaSource(DataSource):
    """spark.read.format("fasta").option("paths", "a.fa,b.fa").load(): one partition a file, on a file system every executor mounts.
    For stores that only Spark reads, use formats.read_files and formats.read_fasta."""

    @classmethod
    def name(cls):
        return "fasta"

    def schema(self):
        return "path string, record_no int, name string, seq string"

    def reader(self, schema):
        return _Reader([p for p in self.options.get("paths", "").split(",") if p])


@udtf(returnType="enzyme_id string, strand int, start0 int")
class FindSites:
    """find_sites(seq, circular, enzyme): the sites of one enzyme in one sequence, for lateral joins in SQL."""

    def eval(self, seq: str, circular: bool, enzyme: str):
        for e in enzymes(enzyme) if seq and enzyme else []:
            site = e["recognition"]
            hay = seq + seq[: len(site) - 1] if circular and len(seq) >= len(site) else seq
            for strand, text in ((1, site), (-1, rc(site))):
                if strand == 1 or text != site:
                    for m in re.finditer(f"(?={site_class(text)})", hay):
                        yield e["enzyme_id"], strand, m.start()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastaSource)
    spark.udtf.register("find_sites", FindSites)
