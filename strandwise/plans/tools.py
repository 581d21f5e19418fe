"""The operations as named tools with arguments and effects, and batches of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions.tables import enzymes
from ..operators import crispr, digest, orf, restriction


@dataclass(frozen=True)
class Tool:
    """run(docs, **arguments) -> DataFrame. effect: read, or stage for what waits for approval."""

    run: Callable[..., DataFrame]
    arguments: tuple[str, ...] = ()
    effect: str = "read"
    aliases: tuple[str, ...] = field(default=())


def _sites(docs: DataFrame, names: list[str]) -> DataFrame:
    return restriction.restriction_sites(docs, enzymes(*names))


TOOLS = {
    "analyze_restriction_sites": Tool(_sites, ("names",)),
    "simulate_digest": Tool(lambda docs, names: digest.fragments(docs.select("doc_id", "topology", "n"), digest.cuts(_sites(docs, names))), ("names",), aliases=("digest",)),
    "find_orfs": Tool(lambda docs, least_codons=30: orf.open_reading_frames(docs, least_codons), ("least_codons",)),
    "find_crispr_targets": Tool(lambda docs, nuclease="SpCas9", most=20: crispr.top_targets(crispr.targets(docs, nuclease), most), ("nuclease", "most")),
}


class ToolError(ValueError):
    """code: UNKNOWN_TOOL or INVALID_ARGUMENT."""

    def __init__(self, code: str, what: str):
        super().__init__(f"{code}: {what}")
        self.code = code


def call(name: str, docs: DataFrame, **arguments) -> DataFrame:
    tool = TOOLS.get(name) or next((t for t in TOOLS.values() if name in t.aliases), None)
    if tool is None:
        raise ToolError("UNKNOWN_TOOL", name)
    if extra := set(arguments) - set(tool.arguments):
        raise ToolError("INVALID_ARGUMENT", ", ".join(sorted(extra)))
    return tool.run(docs, **arguments)


def run_batch(steps: list[tuple[str, dict]], docs: DataFrame) -> tuple[list[DataFrame], str | None]:
    """The results of the steps in order, and the code of the error that stopped them."""
    out = []
    for name, arguments in steps:
        try:
            out.append(call(name, docs, **arguments))
        except ToolError as e:
            return out, e.code
    return out, None
