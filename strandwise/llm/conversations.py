"""Conversation structure repair: the cheapest edits that give system, user and assistant turns their order, by layers of equal cost."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, Scratch, salted_join

#: Grammar states as bits: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = 1, 2, 4, 8
STATES = (START, SYSTEM, USER, ASSISTANT)
#: Costs of the edits.
DELETE, INSERT, REROLE = 3, 2, 2
#: What is still to pay at the end of a conversation in each state: START and ASSISTANT accept, USER wants an assistant, SYSTEM both.
FINAL = (0, 2 * INSERT, INSERT, 0)
#: The role that an insertion or a new role must have in a state.
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: States from which such an edit leads into a set of states, and from which keeping a row of an initial does.
_BEFORE_NEW = [sum(q for q in STATES if _NEXT[q] & m) for m in range(16)]
_KEPT = {"s": (START, SYSTEM), "u": (START | SYSTEM | ASSISTANT, USER), "a": (USER, ASSISTANT), "x": (0, 0)}
#: Rows that are solved at a time; rows and bytes of a block of turns.
PIECE, BLOCK_ROWS, BLOCK_BYTES = 32, 256, 1 << 20


def layers(codes: str, end: tuple, want: int) -> list[list[int]]:
    """Sets of states a row (and one behind the last) from which the end is reached at each increasing cost, from 0 on.

    codes has a letter a row, the initial of its role (x for others), in capitals if the row is truncated; end is what each state
    still has to pay behind the last row, None for never. The layers end with the first whose set before the first row holds want.
    """
    n, out = len(codes), []
    rows = [(*_KEPT[c.lower()], c.isupper()) for c in codes]
    none = [0] * (n + 1)
    back = lambda k: out[len(out) - k] if k <= len(out) else none
    while not out or out[-1][0] & want != want:
        one, two, three = back(1), back(2), back(3)
        own = [0] * (n + 1)
        own[n] = sum(q for q, cost in zip(STATES, end, strict=True) if cost is not None and cost <= len(out))
        for i in range(n - 1, -1, -1):
            source, target, cut = rows[i]
            kept, new = (one, three) if cut else (own, two)
            m = one[i] | _BEFORE_NEW[two[i]] | three[i + 1] | _BEFORE_NEW[new[i + 1]]
            if kept[i + 1] & target:
                m |= source
            own[i] = m
        out.append(own)
    return out


def trace(codes: str, found: list[list[int]], state: int, cost: int) -> tuple[str, int, int]:
    """(audit, state, cost left) behind the last row: the least letters among the cheapest edits, row by row."""
    audit, i, reach = [], 0, lambda c, i: found[c][i] if c >= 0 else 0
    while i < len(codes):
        source, target = _KEPT[codes[i].lower()]
        extra = int(codes[i].isupper())
        if reach(cost - DELETE, i + 1) & state:
            audit.append("D")
            cost, i = cost - DELETE, i + 1
        elif reach(cost - INSERT, i) & _NEXT[state]:
            audit.append("I")
            cost, state = cost - INSERT, _NEXT[state]
        elif source & state and reach(cost - extra, i + 1) & target:
            audit.append("K")
            cost, state, i = cost - extra, target, i + 1
        else:
            audit.append("R")
            cost, state, i = cost - REROLE - extra, _NEXT[state], i + 1
    return "".join(audit), state, cost


def _first(found: list[list[int]], state: int) -> int | None:
    return next((c for c, own in enumerate(found) if own[0] & state), None)


def _pieces(codes: str) -> list[str]:
    """Pieces of the rows that may stay; blank and repeated ones (-, =) always go and leave the state as it is."""
    rest = codes.replace("-", "").replace("=", "")
    return [rest[i : i + PIECE] for i in range(0, len(rest), PIECE)]


def to_pay(piece: str, end: tuple) -> tuple:
    """What each state has to pay before a piece, given what it has to pay behind it."""
    least = min(end)
    found = layers(piece, tuple(c - least for c in end), 15)
    return tuple(_first(found, q) + least for q in STATES)


def matrix(codes: str) -> list[list[int | None]]:
    """Cost from each state before some rows to each state behind them, None if there is no way; without what must go."""
    total = [[0 if a == b else None for b in STATES] for a in STATES]
    for piece in _pieces(codes):
        cols = []
        for x in STATES:
            want = {START: START, SYSTEM: SYSTEM | (START if "s" in piece.lower() else 0)}.get(x, 15)
            found = layers(piece, tuple(0 if q == x else None for q in STATES), want)
            cols.append([_first(found, q) for q in STATES])
        total = [[min((row[k] + cols[x][k] for k in range(4) if row[k] is not None and cols[x][k] is not None), default=None) for x in range(4)] for row in total]
    return total


def solve(codes: str, end: tuple, states: tuple = STATES) -> dict[int, tuple[str, int]]:
    """For each state before some rows: the least of the cheapest audits, and the state behind them."""
    parts, ends = _pieces(codes), [end]
    for p in reversed(parts[1:]):
        ends.append(to_pay(p, ends[-1]))
    ends = ends[::-1]
    # each way goes on by its own state; the layers of a piece serve all of them
    ways = {q: ([], q) for q in states}
    for p, e in zip(parts, ends, strict=False):
        least = min(e)
        found = layers(p, tuple(c - least for c in e), sum({q for _, q in ways.values()}))
        for start, (audit, q) in ways.items():
            more, q, _ = trace(p, found, q, _first(found, q))
            audit.append(more)
            ways[start] = (audit, q)
    out = {}
    for start, (audit, q) in ways.items():
        edits, whole = iter("".join(audit)), []
        for c in codes:
            # what must go goes at once: D comes before I
            edit = "D" if c in "-=" else next(edits)
            while edit == "I":
                whole.append(edit)
                edit = next(edits)
            whole.append(edit)
        out[start] = ("".join(whole), q)
    return out


def trailing(state: int) -> str:
    """Insertions behind the last row."""
    return "I" * (FINAL[STATES.index(state)] // INSERT)


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) after the damage of a test: by crc32 of "conv_id:turn" modulo 20, 0 drops a row, 1 empties its
    text, 2 removes its [.!?], 3 repeats it, 4 makes its role user. Nulls in the key, the role and the text are one space."""
    c = lambda name: F.col(f"`{name}`")
    blank = lambda x: F.coalesce(x.cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(blank(c(conv_col)), F.lit(":"), blank(c(turn_col))), "UTF-8")) % 20
    d = conversations.select(c(conv_col).alias("conv_id"), c(turn_col).alias("turn"), blank(c(role_col)).alias("role"), blank(c(text_col)).alias("text"), kind.alias("kind")).filter("kind <> 0")
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def _blocks(rows: DataFrame) -> DataFrame:
    """(conv_id, part, block, codes, digests, turns, roles, texts): turns in order, up to 256 of a conversation a row.

    Rows are ordered by ranges of (conversation, turn, role, text), so a conversation of any size is split over tasks.
    """
    body = F.btrim("text", F.lit(SPACES))
    initial = F.left("role", F.lit(1))
    code = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    code = F.when(F.length(body) == 0, "-").when(F.substring(body, -1, 1).isin(".", "!", "?"), code).otherwise(F.upper(code))
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.length("role"), "role", "text")
    order = ["conv_id", "turn", "role", F.left("text", F.lit(256)), F.md5("text")]
    d = rows.select("conv_id", "turn", "role", "text", code.alias("code"), F.when(F.length(body) > 0, F.unhex(F.md5(key))).alias("digest"))
    # equal rows may stand in any order: a salt lets ranges divide them
    d = d.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 16)))
    d = d.repartitionByRange(*order, "salt").sortWithinPartitions(*order)
    d = d.select("conv_id", F.spark_partition_id().cast("long").alias("part"), "turn", "role", "text", "code", "digest")

    def run(batches):
        held, size, number, last = [], 0, 0, None

        def flush():
            first = held[0]
            cols = list(zip(*(r[2:] for r in held), strict=True))
            row = [[first[0]], [first[1]], [number], ["".join(cols[3])], [list(cols[4])], [list(cols[0])], [list(cols[1])], [list(cols[2])]]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, kinds, strict=True)], schema=kinds)

        for b in batches:
            kinds = pa.schema([("conv_id", b.schema.field(0).type), ("part", pa.int64()), ("block", pa.int64()), ("codes", pa.string()), ("digests", pa.list_(pa.binary())), ("turns", pa.list_(b.schema.field(2).type)), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
            done = []
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (r[0] != last or len(held) >= BLOCK_ROWS or size > BLOCK_BYTES):
                    done.append(flush())
                    number, held, size = number + 1, [], 0
                held.append(r)
                size += len(r[4])
                last = r[0]
            if done:
                # the blocks of a batch go on together
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
        if held:
            yield flush()

    conv, turn = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    return d.mapInArrow(run, f"conv_id {conv}, part bigint, block bigint, codes string, digests array<binary>, turns array<{turn}>, roles array<string>, texts array<string>")


def _units(blocks: DataFrame) -> DataFrame:
    """(conv_id, part, block, codes, several): the rows of a conversation in one range, a letter each, with repeated ones as "=".

    block is the range's first of the conversation; several tells that it goes on in other ranges.
    """
    rows = blocks.select("part", "block", F.posexplode("digests").alias("at", "digest")).filter("digest is not null")
    place = F.struct("part", "block", "at")
    first = rows.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = salted_join(rows, first, "digest", "n", place).filter(place != F.col("first"))
    again = again.groupBy("part", "block").agg(F.collect_set("at").alias("again"))
    marked = F.array_join(F.transform(F.split("codes", ""), lambda c, i: F.when(F.array_contains("again", i), "=").otherwise(c)), "")
    d = blocks.select("conv_id", "part", "block", "codes").join(again, ["part", "block"], "left")
    d = d.withColumn("codes", F.when(F.col("again").isNull(), F.col("codes")).otherwise(marked))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "codes"))), lambda x: x["codes"]), "")
    units = d.groupBy("conv_id", "part").agg(F.min("block").alias("block"), whole.alias("codes"))
    return units.withColumn("several", F.count(F.lit(1)).over(W.partitionBy("conv_id")) > 1)


_KINDS = {"string": pa.string(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _mapped(df: DataFrame, made: dict[str, str], f, *args: str) -> DataFrame:
    """df with the columns `made` (name and type), a tuple of f(args) a row."""

    def run(batches):
        for b in batches:
            rows = [f(*r) for r in zip(*(b.column(a).to_pylist() for a in args), strict=True)]
            cols = [pa.array([r[k] for r in rows], _KINDS[t]) for k, t in enumerate(made.values())]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *made])

    return df.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in [*df.dtypes, *made.items()]))


def _folded(df: DataFrame, made: dict[str, str], f) -> DataFrame:
    """(part, block, ...) with what f makes of the x of a conversation's ranges in order: as many rows as it has ranges."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        rows = f(t["x"].to_pylist())
        return pa.table({"part": t["part"], "block": t["block"], **{n: pa.array([r[k] for r in rows], _KINDS[made[n]]) for k, n in enumerate(made)}})

    return df.groupBy("conv_id").applyInArrow(run, ", ".join(["part bigint", "block bigint", *(f"{n} {t}" for n, t in made.items())]))


def _ends(matrices: list[list[int | None]]) -> list[tuple]:
    """What each state has to pay behind each range, from the last range back."""
    out, pay = [], list(FINAL)
    for m in reversed(matrices):
        out.append((pay,))
        pay = [min(m[4 * q + x] + pay[x] for x in range(4) if m[4 * q + x] is not None) for q in range(4)]
    return out[::-1]


def _begins(outs: list[list[int]]) -> list[tuple]:
    """(number of the state before each range, insertions behind it), from the first range on."""
    out, q = [], 0
    for k, behind in enumerate(outs):
        after = behind[q]
        out.append((q, trailing(STATES[after]) if k == len(outs) - 1 else ""))
        q = after
    return out


def _audits(units: DataFrame) -> DataFrame:
    """(conv_id, part, audit, codes): the edits of every range of a conversation, as part of the least cheapest audit of the whole."""
    def alone(codes):
        audit, q = solve(codes, FINAL, (START,))[START]
        return (audit + trailing(q),)

    closed = _mapped(units.filter("not several").select("conv_id", "part", "codes"), {"audit": "string"}, alone, "codes")
    # a conversation of several ranges: costs of all ways through each range, then back over the ranges, then forward
    far = units.filter("several").select("conv_id", "part", "block", "codes")
    ways = _mapped(far, {"x": "array<bigint>"}, lambda codes: ([c for row in matrix(codes) for c in row],), "codes")
    ends = _folded(ways.drop("codes"), {"end": "array<bigint>"}, _ends)

    def choose(codes, end):
        found = solve(codes, tuple(end))
        return [found[q][0] for q in STATES], [STATES.index(found[q][1]) for q in STATES]

    chosen = _mapped(far.join(ends, ["part", "block"]), {"audits": "array<string>", "x": "array<bigint>"}, choose, "codes", "end")
    begins = _folded(chosen.select("conv_id", "part", "block", "x"), {"begin": "bigint", "tail": "string"}, _begins)
    joined = chosen.select("conv_id", "part", "block", "codes", "audits").join(begins, ["part", "block"])
    audit = F.concat(F.get("audits", F.col("begin").cast("int")), "tail")
    return closed.unionByName(joined.select("conv_id", "part", "codes", audit.alias("audit")))


_ROLE = {USER: "user", ASSISTANT: "assistant"}


def _walk(batches):
    """(conv_id, edit, code, turn, role, new_role, text) of every turn in order, from blocks before which stand their ranges' audits.

    Inserted turns have no code, turn and role, deleted ones no new role; edit is None at the end of each conversation.
    """
    state, edits, codes, last, begun = START, iter(""), iter(""), None, False

    def rest():
        # only insertions are left behind the last turn
        nonlocal state
        for edit in edits:
            state = _NEXT[state]
            yield last, edit, None, None, None, _ROLE[state], ""

    for b in batches:
        for conv, block, audit, marks, turns, roles, texts in zip(*(b.column(c).to_pylist() for c in ("conv_id", "block", "audit", "codes", "turns", "roles", "texts")), strict=True):
            if block < 0:
                yield from rest()
                if begun and conv != last:
                    yield last, *[None] * 6
                if not begun or conv != last:
                    state, last, begun = START, conv, True
                edits, codes = iter(audit), iter(marks)
                continue
            for turn, role, text in zip(turns, roles, texts, strict=True):
                edit, new = next(edits), None
                while edit == "I":
                    state = _NEXT[state]
                    yield conv, edit, None, None, None, _ROLE[state], ""
                    edit = next(edits)
                if edit == "R":
                    state = _NEXT[state]
                    new = _ROLE[state]
                elif edit == "K":
                    state, new = _KEPT[role[:1]][1], role
                yield conv, edit, next(codes), turn, role, new, text
    yield from rest()
    if begun:
        yield last, *[None] * 6


def _stream(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Blocks of turns and the audits of their ranges, each conversation's in order and in one task."""
    scratch = Scratch(conversations.sparkSession)
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = conversations.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"))
    blocks, _ = scratch.keep(_blocks(rows))
    units, _ = scratch.keep(_units(blocks))
    audits = _audits(units).withColumn("block", F.lit(-1).cast("bigint"))
    parts = blocks.select("conv_id", "part", "block", "turns", "roles", "texts").unionByName(audits, allowMissingColumns=True)
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")


def repaired_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, place, turn, role, text, edit): the turns of the repaired conversations, place from 0; inserted ones have no turn.

    Rules, order and nulls as in repair_report.
    """
    df = _stream(conversations, conv_col, turn_col, role_col, text_col)
    conv, turn = df.schema["conv_id"].dataType.simpleString(), df.schema["turns"].dataType.elementType.simpleString()

    def run(batches):
        place, out, kinds = 0, [], None

        def table():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "place", "turn", "role", "text", "edit"])

        def seen():
            nonlocal kinds
            for b in batches:
                kinds = [b.schema.field("conv_id").type, pa.int64(), b.schema.field("turns").type.value_type, pa.string(), pa.string(), pa.string()]
                yield b

        size = 0
        for c, edit, _, number, _, role, text in _walk(seen()):
            if edit is None:
                place = 0
            elif role is not None:
                out.append((c, place, number, role, text, edit))
                place, size = place + 1, size + len(text)
            if len(out) > 4096 or size > BLOCK_BYTES:
                yield table()
                out.clear()
                size = 0
        if out:
            yield table()

    return df.mapInArrow(run, f"conv_id {conv}, place bigint, turn {turn}, role string, text string, edit string")


def repair_report(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Turns are taken by number, nulls first, equal ones by role and text (its first 256 characters, then its MD5). A turn's first
    fault counts: blank, duplicate (role and text seen before in the conversation), truncated (the last character that isn't white
    space is not one of .!?). gaps are the numbers missing between the least and the largest turn; illegal counts neighbours whose
    roles' initials aren't su, ua or au. Keeping a turn costs 0, a new role (user or assistant) 2, deleting it 3, which blank and
    duplicate ones need, inserting an empty user or assistant turn 2; a truncated turn that stays adds 1. audit has the initials of
    the cheapest edits after which the roles' initials are (s?(ua)+)?, the least string of several. repaired_sha256 is of the
    repaired turns as role:text, joined by line feeds.

    Null role and text are one space, a null conv_id is a conversation; other columns can't clash; an empty table gives no rows.

    Conversations of any length are divided over tasks to be ordered and solved; a range's costs between grammar states (16 numbers)
    tell how its edits depend on the others'. Only the hash needs a conversation's turns in one task, where they are read as a
    stream of blocks. Blocks of turns and their codes are written to the shared folder.
    """
    df = _stream(conversations, conv_col, turn_col, role_col, text_col)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches):
        kinds, out = None, []

        def table():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [kinds, *[pa.int64()] * 6, pa.string(), pa.string()], strict=True)], names=["conv_id", *names, "audit", "repaired_sha256"])

        def seen():
            nonlocal kinds
            for b in batches:
                kinds = b.schema.field("conv_id").type
                yield b

        fresh = lambda: ([0] * 6, [], hashlib.sha256(), None, None, None, 0, True)
        n, audit, digest, low, high, before, distinct, empty = fresh()
        for conv, edit, code, turn, role, new, text in _walk(seen()):
            if edit is None:
                n[0] = high - low + 1 - distinct if distinct else 0
                out.append((conv, *n, "".join(audit), digest.hexdigest()))
                if len(out) >= 4096:
                    yield table()
                    out.clear()
                n, audit, digest, low, high, before, distinct, empty = fresh()
                continue
            audit.append(edit)
            if code is not None:
                if turn is not None and turn != high:
                    low, high, distinct = turn if low is None else low, turn, distinct + 1
                if before is not None and before + role[:1] not in ("su", "ua", "au"):
                    n[4] += 1
                before = role[:1]
                fault = {"-": 1, "=": 2}.get(code, 3 if code.isupper() else 0)
                if fault:
                    n[fault] += 1
                n[5] += fault == 3 and edit != "D"
            n[5] += {"D": DELETE, "I": INSERT, "R": REROLE, "K": 0}[edit]
            if new is not None:
                digest.update((("" if empty else "\n") + new + ":" + text).encode("utf-8", "replace"))
                empty = False
        if out:
            yield table()

    conv = df.schema["conv_id"].dataType.simpleString()
    return df.mapInArrow(run, f"conv_id {conv}, {', '.join(f'{c} bigint' for c in names)}, audit string, repaired_sha256 string")


def op12_conversation_repair(spark, sf_dir):
    from .common import table

    c = table(spark, sf_dir, "conversations")
    found = repair_report(damage(c)).withColumnRenamed("conv_id", "id")
    every = c.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left").drop("id")
    fill = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return every.select("conv_id", *[F.coalesce(x, fill.get(x, F.lit(0).cast("bigint"))).alias(x) for x in found.columns[1:]])


def _sql() -> str:
    """The same by a recursive query over the turns, each state with its least (cost, audit) and the repaired turns."""

    def least(*xs: str) -> str:
        return f"list_min([{', '.join(xs)}])"

    def step(x: str, cost: str, letter: str, line: str = "") -> str:
        t = f"list_append({x}.t, {line})" if line else f"{x}.t"
        return f"CASE WHEN {x} IS NOT NULL THEN {{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 't': {t}}} END"

    any_u = least("y0", "ys", "ya")
    inserted = lambda rel: f"SELECT *, {least('xa', step('yu', '2', 'I', chr(39) + 'assistant:' + chr(39)))} AS ya FROM (SELECT *, x0 AS y0, xs AS ys, {least('xu', step('x0', '2', 'I', chr(39) + 'user:' + chr(39)), step('xs', '2', 'I', chr(39) + 'user:' + chr(39)), step('xa', '2', 'I', chr(39) + 'user:' + chr(39)))} AS yu FROM {rel})"
    own = "role || ':' || text"
    keep = lambda x, s: f"CASE WHEN NOT forced AND left(role, 1) = '{s}' THEN {step(x, 'cut', 'K', own)} END"
    new = lambda x, r: f"CASE WHEN NOT forced THEN {step(x, '2 + cut', 'R', chr(39) + r + ':' + chr(39) + ' || text')} END"
    turn = f"""SELECT conv_id, i + 1 AS i, n, {step('y0', '3', 'D')} AS x0, {least(step('ys', '3', 'D'), keep('y0', 's'))} AS xs,
      {least(step('yu', '3', 'D'), keep('v', 'u'), new('v', 'user'))} AS xu, {least(step('ya', '3', 'D'), keep('yu', 'a'), new('yu', 'assistant'))} AS xa
    FROM (SELECT y.*, r.role, r.text, r.forced, r.cut, {any_u} AS v FROM ({inserted('dp')}) y JOIN r ON r.conv_id IS NOT DISTINCT FROM y.conv_id AND r.i = y.i + 1)"""
    s = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    empty = "{'c': CAST(0 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])}"
    return rf"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda h, b: CASE WHEN h & 1 = 1 THEN xor(h >> 1, 3988292384) ELSE h >> 1 END) ORDER BY i) AS t FROM range(256) x(i)
), raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), hit AS (
  SELECT raw.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, b: xor(h >> 8, tab.t[xor(h & 255, b) + 1])), 4294967295) % 20 AS k FROM raw, tab
), dm AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM hit WHERE k <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 256), md5(text)) AS i, trim(text, {s}) AS body FROM dm
), f AS (
  SELECT *, body = '' AS blank, body <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup, body <> '' AND right(body, 1) NOT IN ('.', '!', '?') AS cut0, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o
), r AS (SELECT conv_id, i, role, text, blank OR dup AS forced, CASE WHEN cut0 AND NOT dup THEN 1 ELSE 0 END AS cut FROM f),
dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, count(*) AS n, {empty} AS x0, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR[])) AS xs, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR[])) AS xu, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR[])) AS xa FROM r GROUP BY conv_id
  UNION ALL
  {turn}
), z AS (SELECT conv_id, {least('y0', 'ya')} AS best FROM ({inserted('dp')}) WHERE i = n),
g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate,
         count(*) FILTER (WHERE cut0 AND NOT dup) AS truncated, count(*) FILTER (WHERE before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
"""


SQL = _sql()
