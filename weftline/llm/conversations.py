"""Repair of conversations: faults by row, the cheapest edits that give a legal order of turns, and what was repaired as a hash.

A conversation's rows are read in the order of (turn, role, text), nulls first. A row's first fault counts: blank (no character other than
white space), duplicate (its role and text stood earlier), truncated (its last such character isn't one of ``.!?``). Edits: Keep 0, Rerole 3,
Delete 4 (the only one for blanks and duplicates), Insert an empty turn 3; a truncated row that stays adds 3. A cost-to-go over (row, grammar
state) is found backward, then a walk forward takes the ASCII-least edit among those that keep to it.

Rows are range-partitioned by (conv_id, turn, role, start of the text) and cut into pieces, so that a task holds one piece of a conversation
and never all of it. A conversation that lies within one partition and piece is done there and its texts move no further. Of others, codes of
one byte a row meet in a task, as its result has a letter a row too; their texts are streamed piece by piece into the hash.

Null roles and texts count as one space, which is no legal initial; an empty role has no initial and is never kept. A null conv_id is a
conversation of its own, null turns stand first and aren't counted in gaps. Equal rows are duplicates of the first. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import shared

#: Rows and bytes of text after which a piece is closed.
PIECE_ROWS, PIECE_BYTES = 4096, 4 << 20
#: Characters of a text by which rows of the same turn and role are dealt out.
KEY_CHARS = 256
SPACE = " \t\n\x0b\x0c\r"
#: Faults and initials, as a row's code has them: fault + 4 * initial.
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
INITIALS = {"u": 1, "a": 2, "s": 3}
LEGAL = {(3, 1), (1, 2), (2, 1)}
#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a. A turn to be inserted or given another role follows from the state.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEEPS = {(START, 1): USER, (SYSTEM, 1): USER, (ASSISTANT, 1): USER, (USER, 2): ASSISTANT, (START, 3): SYSTEM}
DELETE, INSERT, KEEP, REROLE = "DIKR"
COST = {DELETE: 4, INSERT: 3, KEEP: 0, REROLE: 3}
#: Cost and inserts at the end, by state.
END, END_INSERTS = (0, 6, 3, 0), (0, 2, 1, 0)
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
PIECE = "block int, part int, codes binary, fresh array<int>, roles array<string>, texts array<string>, turn_first long, turn_last long, turns long, tail int"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and there of each row after the damage that the crc32 of ``conv_id:turn`` says; of a dropped row nothing but
    its conversation is left (there is false)."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    role, text, harm = F.coalesce("role", space), F.coalesce("text", space), F.crc32(key.cast("binary")) % 20
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), harm.alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "harm", F.explode(F.sequence(F.lit(1), F.when(F.col("harm") == 3, 2).otherwise(1))).alias("copy"))
    gone = F.col("harm") == 0
    return rows.select("conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(~gone, F.col("role")).alias("role"), F.when(~gone, F.col("text")).alias("text"), (~gone).alias("there"))


def code_of(role: str, text: str, seen: set) -> int:
    bare = text.rstrip(SPACE)
    fault = BLANK if not bare else DUPLICATE if (role, text) in seen else TRUNCATED if bare[-1] not in ".!?" else OK
    seen.add((role, text))
    return fault + 4 * INITIALS.get(role[:1], 0)


def step_of(code: int, after: tuple) -> tuple[tuple, int, tuple]:
    """One row back: the costs to go from each state, less their least; that least; and each state's (inserts, edit, next state)."""
    fault, initial = code % 4, code // 4
    more = 3 if fault == TRUNCATED else 0
    edits = []
    for q in range(4):
        own = {DELETE: (COST[DELETE] + after[q], q)}
        if fault in (OK, TRUNCATED):
            if (q, initial) in KEEPS:
                own[KEEP] = (more + after[KEEPS[q, initial]], KEEPS[q, initial])
            own[REROLE] = (more + COST[REROLE] + after[NEXT[q]], NEXT[q])
        edits.append(own)
    cost = [min(c for c, _ in own.values()) for own in edits]
    for _ in range(3):
        cost = [min(c, COST[INSERT] + cost[NEXT[q]]) for q, c in enumerate(cost)]
    taken = []
    for q in range(4):
        inserts, at = 0, q
        while True:  # D, I, K, R: the first that keeps to the cost
            tight = {e for e, (c, _) in edits[at].items() if c == cost[at]}
            if DELETE not in tight and cost[at] == COST[INSERT] + cost[NEXT[at]]:
                inserts, at = inserts + 1, NEXT[at]
                continue
            edit = min(tight)
            taken.append((inserts, edit, edits[at][edit][1]))
            break
    least = min(cost)
    return tuple(c - least for c in cost), least, tuple(taken)


def plan(codes: bytes, known: dict) -> tuple[bytes, int]:
    """A byte for each row, 4 * inserts before it + its edit's place in DIKR, and the inserts after the last row. known: steps found before."""
    after, steps, path = END, known.setdefault("steps", []), array("L")
    for code in reversed(codes):
        if (found := known.get((code, after))) is None:
            before, _, taken = step_of(code, after)
            steps.append(taken)
            known[code, after] = found = before, len(steps) - 1
        after, k = found
        path.append(k)
    acts, state = bytearray(), START
    for k in reversed(path):
        inserts, edit, state = steps[k][state]
        acts.append(4 * inserts + "DIKR".index(edit))
    return bytes(acts), END_INSERTS[state]


class Repair:
    """What is known of a conversation after some of its pieces."""

    def __init__(self):
        self.counts, self.audit, self.hash = [0] * 6, [], hashlib.sha256()
        self.state, self.last, self.lines = START, None, 0
        self.least = self.most = None
        self.turns = 0

    def line(self, role: str, text: str) -> None:
        self.hash.update(("\n" * (self.lines > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.lines += 1

    def insert(self, times: int) -> None:
        for _ in range(times):
            self.state = NEXT[self.state]
            self.line(ROLE[self.state], "")
        self.audit.append(INSERT * times)
        self.counts[5] += COST[INSERT] * times

    def add(self, codes: bytes, acts: bytes, roles: list, texts: list, first: int | None, last: int | None, turns: int) -> None:
        for code, act, role, text in zip(codes, acts, roles, texts, strict=True):
            fault, initial, edit = code % 4, code // 4, "DIKR"[act % 4]
            if fault:
                self.counts[fault] += 1
            self.counts[4] += self.last is not None and (self.last, initial) not in LEGAL
            self.last = initial
            self.insert(act // 4)
            self.audit.append(edit)
            self.counts[5] += COST[edit] + (3 if fault == TRUNCATED and edit != DELETE else 0)
            if edit != DELETE:
                self.state = KEEPS[self.state, initial] if edit == KEEP else NEXT[self.state]
                self.line(role if edit == KEEP else ROLE[self.state], text)
        if first is not None:
            self.turns += turns - (self.most == first)
            self.least, self.most = first if self.least is None else self.least, last

    def values(self) -> tuple:
        self.counts[0] = self.most - self.least + 1 - self.turns if self.turns else 0
        return *self.counts, "".join(self.audit), self.hash.hexdigest()


def _written(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _schema(rows: DataFrame, more: str) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {more}"
    return ddl, to_arrow_schema(StructType.fromDDL(ddl))


def pieces(rows: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Of damaged rows: a result for each conversation that lies within a partition and a piece, and the pieces of others."""
    ddl, schema = _schema(rows, f"open boolean, {RESULT}, {PIECE}")
    n_result, n_piece = RESULT.count(",") + 1, PIECE.count(",") + 1

    def run(batches):
        known: dict = {}
        block = TaskContext.get().partitionId()
        out: list[tuple] = []
        conv, part, first_conv, size = None, -1, True, 0
        seen: set = set()
        codes, fresh, roles, texts, turns = bytearray(), [], [], [], []

        def closed(conv_ends: bool, task_ends: bool):
            nonlocal part, size
            given = [t for t in turns if t is not None]
            span = (given[0], given[-1], len(set(given))) if given else (None, None, 0)
            if conv_ends and part == 0 and not first_conv and not task_ends:
                acts, tail = plan(bytes(codes), known)
                done = Repair()
                done.add(bytes(codes), acts, roles, texts, *span)
                done.insert(tail)
                out.append((conv, False, *done.values(), *[None] * n_piece))
            else:
                out.append((conv, True, *[None] * n_result, block, part, bytes(codes), list(fresh), list(roles), list(texts), *span, 0))
            part, size = part + 1, 0
            for x in (codes, fresh, roles, texts, turns, seen):
                x.clear()

        for batch in batches:
            for c, turn, role, text, there in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if part < 0 or c != conv:
                    if part >= 0:
                        closed(True, False)
                        first_conv = False
                    conv, part = c, 0
                elif len(codes) >= piece_rows or size >= piece_bytes:
                    closed(False, False)
                if there:
                    code = code_of(role, text, seen)
                    if code % 4 in (OK, TRUNCATED):
                        fresh.append(len(codes))
                    codes.append(code)
                    roles.append(role)
                    texts.append(text)
                    turns.append(turn)
                    size += len(text)
                if len(out) >= 1000 or out and out[-1][1] and len(out) >= 8:
                    yield _written(out, schema)
                    out.clear()
        if part >= 0:
            closed(True, True)
        if out:
            yield _written(out, schema)

    order = ["conv_id", "turn", "role"]
    dealt = rows.repartitionByRange(*order, F.substring("text", 1, KEY_CHARS)).sortWithinPartitions(*order, "text")
    return dealt.select("conv_id", "turn", "role", "text", "there").mapInArrow(run, ddl)


def _planned(open_pieces: DataFrame) -> DataFrame:
    """codes, acts and tail of each piece of a conversation that has several; the codes of a whole conversation meet, its texts don't."""
    at = ["c", "none", "block", "part"]
    new = open_pieces.select(*at, "roles", "texts", F.explode("fresh").alias("p"))
    role, text = F.element_at("roles", F.col("p") + 1), F.element_at("texts", F.col("p") + 1)
    new = new.select(*at, "p", F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), role, text).alias("h2"))
    # a piece has a text once at most: a window holds no more rows than the conversation has pieces
    seen = new.withColumn("r", F.row_number().over(Window.partitionBy("c", "none", "h1", "h2").orderBy("block", "part"))).where("r > 1")
    again = seen.groupBy(*at).agg(F.collect_list("p").alias("again"))
    rows = open_pieces.select(*at, "codes").join(again, at, "left")
    rows = rows.groupBy("c", "none").agg(F.array_sort(F.collect_list(F.struct("block", "part", "codes", F.coalesce("again", F.array().cast("array<int>")).alias("again")))).alias("all"))

    def work(batch):
        known: dict = {}
        out: dict = {k: [] for k in ("c", "none", "block", "part", "codes", "acts", "tail")}
        for c, none, every in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            codes = [bytearray(p["codes"]) for p in every]
            for own, p in zip(codes, every, strict=True):
                for k in p["again"]:
                    own[k] = own[k] // 4 * 4 + DUPLICATE
            acts, tail = plan(b"".join(codes), known)
            done = 0
            for k, (own, p) in enumerate(zip(codes, every, strict=True)):
                row = (c, none, p["block"], p["part"], bytes(own), acts[done : done + len(own)], tail if k == len(every) - 1 else 0)
                done += len(own)
                for name, v in zip(out, row, strict=True):
                    out[name].append(v)
        yield out

    return shared.by_batch(rows, work, "c string, none boolean, block int, part int, codes binary, acts binary, tail int")


def repaired(rows: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """A row for each conversation of damaged rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    found = shared.stored(pieces(rows, piece_rows, piece_bytes))
    names = ["conv_id", *(x.split()[0] for x in RESULT.split(", "))]
    key = [F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c"), F.col("conv_id").isNull().alias("none")]
    left = found.where("open").select(*key, "conv_id", "block", "part", "codes", "fresh", "roles", "texts", "turn_first", "turn_last", "turns")
    planned = shared.stored(_planned(left))
    whole = left.drop("codes", "fresh").join(planned, ["c", "none", "block", "part"])
    whole = whole.select("c", "none", "block", "part", "conv_id", "codes", "acts", "roles", "texts", "turn_first", "turn_last", "turns", "tail")
    ddl, schema = _schema(rows, RESULT)

    def run(batches):
        now, conv, done, out = None, None, None, []
        for batch in batches:
            for c, none, _, _, own, codes, acts, roles, texts, first, last, turns, tail in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (c, none) != now:
                    if done is not None:
                        out.append((conv, *done.values()))
                    now, conv, done = (c, none), own, Repair()
                done.add(codes, acts, roles, texts, first, last, turns)
                done.insert(tail)
                if len(out) >= 1000:
                    yield _written(out, schema)
                    out = []
        if done is not None:
            out.append((conv, *done.values()))
        if out:
            yield _written(out, schema)

    several = whole.repartition("c", "none").sortWithinPartitions("c", "none", "block", "part").mapInArrow(run, ddl)
    return found.where("NOT open").select(*names).unionByName(several)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(shared.table(spark, sf_dir, "conversations")))


def _insert(q: str, role: str) -> str:
    return f"{{'cost': 3 + {q}.cost, 'audit': 'I' || {q}.audit, 'lines': list_prepend('{role}:', {q}.lines)}}"


def _edits(q: int) -> str:
    to = f"f{NEXT[q]}"
    role = ROLE[NEXT[q]]
    keeps = " ".join(f"WHEN '{i}' THEN {{'cost': more + f{KEEPS[q, k]}.cost, 'audit': 'K' || f{KEEPS[q, k]}.audit, 'lines': list_prepend(role || ':' || text, f{KEEPS[q, k]}.lines)}}" for i, k in INITIALS.items() if (q, k) in KEEPS)
    options = [
        f"{{'cost': 4 + f{q}.cost, 'audit': 'D' || f{q}.audit, 'lines': f{q}.lines}}",
        f"CASE WHEN fault IN ('', 'truncated') THEN CASE left(role, 1) {keeps} END END",
        f"CASE WHEN fault IN ('', 'truncated') THEN {{'cost': 3 + more + {to}.cost, 'audit': 'R' || {to}.audit, 'lines': list_prepend('{role}:' || text, {to}.lines)}} END",
    ]
    return f"list_sort(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))[1] AS g{q}"


#: DuckDB has no crc32, so it is made bit by bit. The least (cost, audit) is found by comparing whole strings, without a walk.
OP11_SQL = f"""WITH RECURSIVE crc AS (SELECT list(t ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256) r(i))),
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS key FROM conversations),
h AS (SELECT o.*, xor(list_reduce(list_prepend(4294967295, list_transform(key, lambda x: ord(x)::BIGINT)), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS harm FROM o, crc),
d AS (SELECT conv_id, turn, CASE harm WHEN 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE harm WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS bare FROM d),
f AS (SELECT conv_id, turn, role, text, i, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM n),
m AS (SELECT *, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM f),
ends AS (SELECT conv_id, max(i) AS i, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM m GROUP BY 1),
w AS (SELECT conv_id, i, {{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}} AS f0, {{'cost': 6::BIGINT, 'audit': 'II', 'lines': ['user:', 'assistant:']}} AS f1, {{'cost': 3::BIGINT, 'audit': 'I', 'lines': ['assistant:']}} AS f2, {{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}} AS f3 FROM ends
UNION ALL SELECT conv_id, i, list_sort([g0, {_insert('f2', 'user')}])[1], list_sort([g1, {_insert('f2', 'user')}])[1], f2, f3 FROM
(SELECT conv_id, i, g0, g1, list_sort([g2, {_insert('g3', 'assistant')}])[1] AS f2, list_sort([g3, {_insert('g2', 'user')}])[1] AS f3 FROM
(SELECT w.conv_id, w.i - 1 AS i, {', '.join(map(_edits, range(4)))} FROM w JOIN m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i)))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(f0.cost, 0) AS cost, coalesce(f0.audit, '') AS audit, sha256(coalesce(array_to_string(f0.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = 0"""
