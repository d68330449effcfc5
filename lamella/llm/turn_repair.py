"""Repair of conversations' structure: the cheapest edits that make a conversation's roles fit the grammar ``(s?(ua)+)?``.

A conversation is a walk through four states of the grammar: at the start, after the system turn, after a user turn, after an
assistant turn. Each row is kept, given another role, or deleted, and turns may be inserted before it. Conversations are dealt
by a hash of their id and sorted; a task takes some thousands of rows at a time, and one recursive query advances one turn for
all of their conversations at once, keeping for each state the least cost and, of equal costs, the ASCII-least audit.

A long conversation is cut into runs of ``RUN`` rows. Of each the query works out the cheapest way from every state to every
state, and the runs are then chained, so that no query recurses deeper than ``RUN`` and a conversation may go on from batch to
batch: only its four states, audits and digests are held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, bounded_batches, released, vacate
from .importance import CRC_SQL, crc_of

#: Costs of giving a row another role, deleting it, inserting an empty turn; and what a truncated row adds that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows that a recursion takes one after the other, and that a task works on at a time.
RUN, ROWS = 64, 8192
#: What a task's DuckDB may take; its tables are a batch's states.
MEMORY = "256MB"
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a role's initial leads from a state, and what ends a conversation there.
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
CLEAN, UNFIT, CUT = range(3)  # a row's fault: none, blank or duplicate, truncated
BLANKS = " \t\n\x0B\f\r"


def inserted(state: int) -> Iterator[tuple[int, int, str]]:
    """(state, cost, letters) after none to three inserted turns; each state takes one kind only, and more than three go in a circle."""
    for n in range(4):
        yield state, n * INSERT, "I" * n
        state = next(STEPS[state, r] for r in ROLES if (state, r) in STEPS)


@cache
def moves() -> list[tuple[int, str, int, int, int, str]]:
    """(state, initial, fault, next state, cost, letters): the cheapest, then ASCII-least way over one row. Initial ``-``: any other."""
    best: dict[tuple[int, str, int, int], tuple[int, str]] = {}
    for state in range(4):
        for before, cost, letters in inserted(state):
            for initial in "sua-":
                for fault in (CLEAN, UNFIT, CUT):
                    ways = [(before, DELETE, "D")]
                    if fault != UNFIT:
                        more = TRUNCATED if fault == CUT else 0
                        ways += [(STEPS[before, initial], more, "K")] if (before, initial) in STEPS else []
                        ways += [(STEPS[before, r], REROLE + more, "R") for r in ROLES if (before, r) in STEPS]
                    for to, c, edit in ways:
                        key, made = (state, initial, fault, to), (cost + c, letters + edit)
                        best[key] = min(best.get(key, made), made)
    return [(*k, *v) for k, v in sorted(best.items())]


def endings() -> dict[int, tuple[int, str]]:
    """Cost and letters of the inserts that end a conversation from each state."""
    return {s: min((c, x) for to, c, x in inserted(s) if to in ENDS) for s in range(4)}


#: Advances all runs of a batch by one row in each recursion. ``rows`` has (run, i, initial, fault), ``runs`` (run, size, state).
SQL = """
WITH RECURSIVE walk AS (
  SELECT run, 0 AS i, state AS origin, state, 0 AS cost, '' AS audit FROM runs
  UNION ALL
  SELECT run, i, origin, state, best.cost AS cost, best.audit AS audit FROM (
    SELECT w.run, w.i + 1 AS i, w.origin, m.target AS state, min({'cost': w.cost + m.cost, 'audit': w.audit || m.letters}) AS best
    FROM walk w JOIN rows r ON r.run = w.run AND r.i = w.i JOIN moves m ON m.state = w.state AND m.initial = r.initial AND m.fault = r.fault
    GROUP BY ALL)
)
SELECT w.run, origin, w.state, cost, audit FROM walk w JOIN (SELECT DISTINCT run, size FROM runs) z ON z.run = w.run AND z.size = w.i
"""


class Walk:
    """A conversation as far as it has been read: for each state that can be reached its cost, audit and digest, and the counts."""

    def __init__(self):
        self.states: dict[int, tuple[int, str, object, bool]] = {START: (0, "", hashlib.sha256(), True)}
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first = self.last = self.initial = None

    def line(self, digest, first: bool, role: str, text: str) -> None:
        digest.update((("" if first else "\n") + f"{role}:{text}").encode())

    def written(self, state: int, digest, first: bool, letters: str, rows: list[tuple[str, str]]) -> tuple[object, bool]:
        """The digest and whether nothing is written yet, after the edits ``letters`` from ``state`` over ``rows`` of (role, text)."""
        digest, at = digest.copy(), 0
        for edit in letters:
            if edit == "D":
                at += 1
                continue
            if edit == "K":
                role, text = rows[at]
                state = STEPS[state, role[:1]]
            else:
                r = next(r for r in ROLES if (state, r) in STEPS)
                role, text, state = ROLES[r], rows[at][1] if edit == "R" else "", STEPS[state, r]
            at += edit != "I"
            self.line(digest, first, role, text)
            first = False
        return digest, first

    def over(self, ways: list[list[tuple[int, int, int, str]]], rows: list[tuple[str, str]]) -> None:
        """Goes on over runs, each as its ways (origin, state, cost, audit)."""
        found = {s: (cost, audit, s, "") for s, (cost, audit, _, _) in self.states.items()}  # from: state at the batch's start, letters
        for run in ways:
            nearer: dict[int, tuple[int, str, int, str]] = {}
            for origin, state, cost, audit in run:
                if origin in found:
                    c, a, start, letters = found[origin]
                    made = (c + cost, a + audit, start, letters + audit)
                    nearer[state] = min(nearer.get(state, made), made)
            found = nearer
        self.states = {s: (cost, audit, *self.written(start, *self.states[start][2:], letters, rows)) for s, (cost, audit, start, letters) in found.items()}

    def end(self) -> tuple[int, str, str]:
        """Cost, audit and digest of the cheapest way to an end."""
        ends = endings()
        cost, audit, state = min((cost + ends[s][0], audit + ends[s][1], s) for s, (cost, audit, _, _) in self.states.items())
        digest, _ = self.written(state, *self.states[state][2:], ends[state][1], [])
        return cost, audit, digest.hexdigest()


RESULTS = T.StructType([T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [T.StructField(n, T.StringType()) for n in ("audit", "repaired_sha256")])


def _walked(rows: DataFrame, length: int, size: int) -> DataFrame:
    """One row for each conversation of ``rows``, which come sorted by conversation and order in each partition."""
    bounded_batches(rows)
    schema = T.StructType([rows.schema["conv"], *RESULTS.fields])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate("")
        with duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""}) as con:
            values = ", ".join(f"({s}, '{i}', {f}, {t}, {c}, '{x}')" for s, i, f, t, c, x in moves())
            con.execute(f"CREATE TABLE moves AS SELECT * FROM (VALUES {values}) v(state, initial, fault, target, cost, letters)")
            held: tuple[object, Walk] | None = None  # the conversation that the next batch may go on with
            for whole in batches:
                for at in range(0, whole.num_rows, size):
                    batch = whole.slice(at, size).to_pydict()
                    out, held = advanced(con, batch, held)
                    if out:
                        yield made(out)
                released()
            if held:
                yield made([ended(*held)])

    def advanced(con, b: dict[str, list], held) -> tuple[list[tuple], tuple[object, Walk]]:
        """What has ended before the last conversation of the batch, and that one."""
        spans = []
        for key, members in groupby(range(len(b["conv"])), key=b["conv"].__getitem__):
            at = list(members)
            spans.append((key, at[0], at[-1] + 1))
        walks, out, runs, rows = [], [], [], []
        for n, (key, lo, hi) in enumerate(spans):
            walk = held[1] if n == 0 and held and held[0] == key else Walk()
            if n == 0 and held and held[1] is not walk:
                out.append(ended(*held))
            stay = [i for i in range(lo, hi) if not b["gone"][i]]
            noted(walk, b, stay)
            cut = [stay[k : k + length] for k in range(0, len(stay), length)]
            walks.append((key, walk, stay, range(len(runs), len(runs) + len(cut))))
            for k, part in enumerate(cut):
                for i, r in enumerate(part):
                    rows.append((len(runs), i, initial if (initial := b["role"][r][:1]) in ("s", "u", "a") else "-", b["fault"][r]))
                runs.append((len(part), sorted(walk.states) if not k else range(4)))
        ways: list[list] = [[] for _ in runs]
        if rows:
            con.register("rows", pa.table({n: pa.array(v) for n, v in zip(("run", "i", "initial", "fault"), zip(*rows, strict=True), strict=True)}))
            starts = [(n, size, s) for n, (size, states) in enumerate(runs) for s in states]
            con.register("runs", pa.table({n: pa.array(v) for n, v in zip(("run", "size", "state"), zip(*starts, strict=True), strict=True)}))
            for n, *way in con.execute(SQL).fetchall():
                ways[n].append(tuple(way))
        for key, walk, stay, mine in walks:
            walk.over([ways[n] for n in mine], [(b["role"][i], b["text"][i]) for i in stay])
        out += [ended(key, walk) for key, walk, _, _ in walks[:-1]]
        return out, walks[-1][:2]

    def noted(walk: Walk, b: dict[str, list], stay: list[int]) -> None:
        for i in stay:
            kind, turn, initial = b["kind"][i], b["turn"][i], b["role"][i][:1]
            walk.blank += kind == "blank"
            walk.duplicate += kind == "duplicate"
            walk.truncated += kind == "truncated"
            if walk.initial is not None:
                walk.illegal += walk.initial + initial not in ("su", "ua", "au")
            walk.initial = initial
            if turn is not None:
                walk.distinct += turn != walk.last
                walk.first = turn if walk.first is None else walk.first
                walk.last = turn

    def ended(key, walk: Walk) -> tuple:
        gaps = walk.last - walk.first + 1 - walk.distinct if walk.distinct else 0
        return (key, gaps, walk.blank, walk.duplicate, walk.truncated, walk.illegal, *walk.end())

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(zip(*out, strict=True), target, strict=True)], schema=target)

    return rows.mapInArrow(run, schema)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None, run: int = RUN, batch: int = ROWS) -> DataFrame:
    """One row for each conversation: ``conv``, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn (nulls first), then role, then text. A row is blank without a character other than ``BLANKS``, else
    duplicate if an earlier one has its role and text, else truncated if its last such character isn't one of ``.!?``. audit has the
    cheapest edits' initials (Keep, Rerole, Delete, Insert), of equal costs the ASCII-least; the digest is of the repaired
    ``role:text`` lines. A null role or text is one space, a null id a conversation. Rows that ``gone`` marks aren't there, but
    their conversation is; one without rows has zeros, an empty audit and the digest of nothing. No other column is read; an empty
    table gives no rows.

    ``run`` rows of a conversation are one recursion's, ``batch`` rows a query's; no result hangs on either. A conversation's rows pass through one task, sorted, as its digest is of one text; the task holds a batch of them, and of what
    came before four audits and digests."""
    turns = [F.col("turn").asc_nulls_first()]
    each = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"), F.coalesce(F.col(gone), F.lit(False)).alias("gone") if gone else F.lit(False).alias("gone"))
    end = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    seen = F.row_number().over(Window.partitionBy("conv", "gone", "role", "text").orderBy(*turns)) > 1  # by conversation: one shuffle
    kind = F.when(end == "", "blank").when(F.col("seen"), "duplicate").when(~end.isin(".", "!", "?"), "truncated").otherwise("")
    fault = F.when(F.col("kind").isin("blank", "duplicate"), UNFIT).when(F.col("kind") == "truncated", CUT).otherwise(CLEAN)
    marked = each.repartition("conv").withColumn("seen", seen).withColumn("kind", kind).withColumn("fault", fault).drop("seen")
    return _walked(marked.sortWithinPartitions("conv", *turns, "role", "text"), run, batch).withColumnRenamed("conv", conv)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of ``conversations`` after damage that the CRC-32 of their id and turn decides; those that it drops are marked gone."""
    fate = F.col("fate")
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = rows.withColumn("fate", F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")) % 20)
    text = F.when(fate == 1, "").when(fate == 2, F.translate(as_text("text"), ".!?", "")).otherwise(as_text("text"))
    copies = F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return hit.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(as_text("role")).alias("role"), text.alias("text"), (fate == 0).alias("gone"), copies).drop("copy")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")), gone="gone")


_CRC = crc_of("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
_STEPS = "(0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)"
_INSERTS = "(0, 0, 0, []), (0, 1, 2, ['u']), (0, 2, 3, ['u', 'a']), (1, 0, 1, []), (1, 1, 2, ['u']), (1, 2, 3, ['u', 'a']), (2, 0, 2, []), (2, 1, 3, ['a']), (2, 2, 2, ['a', 'u']), (3, 0, 3, []), (3, 1, 2, ['u']), (3, 2, 3, ['u', 'a'])"
_NAMED = "CASE {0} WHEN 'u' THEN 'user' WHEN 'a' THEN 'assistant' END"
OP13_SQL = f"""
WITH RECURSIVE {CRC_SQL},
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, CAST({_CRC} AS BIGINT) % 20 AS fate FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE fate <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
k AS (SELECT *, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS was FROM o),
r AS (SELECT conv_id AS c, turn, i, role, role[1] AS initial, text, was, tail = '' AS blank, tail <> '' AND seen AS duplicate, tail <> '' AND NOT seen AND tail NOT IN ('.', '!', '?') AS truncated FROM k),
steps(state, letter, target) AS (VALUES {_STEPS}),
inserts(state, n, target, letters) AS (VALUES {_INSERTS}),
edits AS (
  SELECT r.c, r.i, f.state, 'D' AS edit, 4 AS cost, f.state AS target, [] AS lines FROM r, (VALUES (0), (1), (2), (3)) f(state)
  UNION ALL SELECT r.c, r.i, s.state, 'K', CASE WHEN truncated THEN 3 ELSE 0 END, s.target, [role || ':' || text] FROM r JOIN steps s ON s.letter = r.initial WHERE NOT blank AND NOT duplicate
  UNION ALL SELECT r.c, r.i, s.state, 'R', CASE WHEN truncated THEN 6 ELSE 3 END, s.target, [{_NAMED.format("s.letter")} || ':' || text] FROM r JOIN steps s ON s.letter <> 's' WHERE NOT blank AND NOT duplicate),
ids AS (SELECT DISTINCT conv_id AS c FROM conversations),
walk(c, i, state, best) AS (
  SELECT c, 0, 0, {{'cost': 0, 'audit': '', 'lines': CAST([] AS VARCHAR[])}} FROM ids
  UNION ALL
  SELECT w.c, w.i + 1, e.target, min({{'cost': w.best.cost + 3 * p.n + e.cost, 'audit': w.best.audit || repeat('I', p.n) || e.edit, 'lines': list_concat(w.best.lines, list_transform(p.letters, lambda x: {_NAMED.format("x")} || ':'), e.lines)}})
  FROM walk w JOIN inserts p ON p.state = w.state JOIN edits e ON e.c IS NOT DISTINCT FROM w.c AND e.i = w.i + 1 AND e.state = p.target GROUP BY w.c, w.i + 1, e.target),
size AS (SELECT c, count(*) AS n, sum(CAST(blank AS BIGINT)) AS blank, sum(CAST(duplicate AS BIGINT)) AS duplicate, sum(CAST(truncated AS BIGINT)) AS truncated, count(*) FILTER (i > 1 AND was || initial NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM r GROUP BY c),
done AS (SELECT w.c, min({{'cost': w.best.cost + 3 * p.n, 'audit': w.best.audit || repeat('I', p.n), 'lines': list_concat(w.best.lines, list_transform(p.letters, lambda x: {_NAMED.format("x")} || ':'))}}) AS best
         FROM walk w LEFT JOIN size ON size.c IS NOT DISTINCT FROM w.c JOIN inserts p ON p.state = w.state WHERE w.i = coalesce(size.n, 0) AND p.target IN (0, 3) GROUP BY w.c)
SELECT d.c AS conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(best.cost AS BIGINT) AS cost, best.audit AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM done d LEFT JOIN size s ON s.c IS NOT DISTINCT FROM d.c
"""
