"""Conversation structure repair (operator 12): cheapest edits by a suffix-shared automaton.

Every turn is one symbol of its role and its fault, a conversation the word of its symbols. Distinct
words are sorted by their reverse, so that words which end alike follow each other: read from the
end they make an automaton whose nodes are the distinct suffixes. For each node and each state of
the role grammar the cost to go and the first edit of the best audit are computed once, whatever the
number of conversations that share the suffix; the rest of that audit is the next node's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import arrow_map, materialise, read, sized

BLANKS = " \t\n\x0b\x0c\r"
#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a; the role that may come next by an edit leads to NEXT.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
_NONE = 1 << 60

Node = tuple[tuple[int, ...], tuple[str, ...]]


def _moved(state: int, role: str) -> int | None:
    """The state after a kept turn of this role, None where the grammar doesn't have it."""
    if role == "s":
        return SYSTEM if state == START else None
    to = {"u": USER, "a": ASSISTANT}.get(role)
    return to if to == NEXT[state] else None


def _with_inserts(best: list[tuple[int, str]]) -> Node:
    """Two inserts in a row lead back, so one round of them after u and a is enough; ties go to the smaller letter."""
    u, a = (min(best[s], (best[NEXT[s]][0] + INSERT, "I")) for s in (USER, ASSISTANT))
    rest = [min(best[s], (u[0] + INSERT, "I")) for s in (START, SYSTEM)]
    return tuple(zip(*rest, u, a, strict=True))


END: Node = _with_inserts([(0, ""), (_NONE, ""), (_NONE, ""), (0, "")])


def node(symbol: str, after: Node) -> Node:
    """Costs and first edits by state of a suffix that begins with symbol. No two edits of one letter lead on from a state."""
    best, extra = [], TRUNCATED if symbol.isupper() else 0
    for state in range(4):
        ways = [(after[0][state] + DELETE, "D")]
        if symbol != "x":
            ways.append((after[0][NEXT[state]] + REROLE + extra, "R"))
            if (to := _moved(state, symbol.lower())) is not None:
                ways.append((after[0][to] + KEEP + extra, "K"))
        best.append(min(ways))
    return _with_inserts(best)


def audit_of(word: str, nodes: list[Node]) -> str:
    """The best edits of a word; nodes[k]: of its last k symbols."""
    out, state, at = [], START, 0
    while True:
        letter = nodes[len(word) - at][1][state]
        out.append(letter)
        if not letter:
            return "".join(out)
        if letter == "K":
            state = _moved(state, word[at].lower())
        elif letter != "D":
            state = NEXT[state]
        at += letter != "I"


def solve(words: DataFrame) -> DataFrame:
    """word, cost, audit for every row of words (word string).

    A task reads its words by their reverse and keeps the nodes of one path: those of the suffix that
    a word shares with the one before stay, so no node is computed twice in a task and only those on
    the border between two tasks are in both.
    """
    back = F.reverse("word")
    ordered = words.select("word").distinct().repartitionByRange(back).sortWithinPartitions(back)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, last = [END], ""
        for b in batches:
            out = []
            for word in b.column("word").to_pylist():
                shared = 0
                for x, y in zip(reversed(word), reversed(last)):
                    if x != y:
                        break
                    shared += 1
                del path[shared + 1 :]
                for symbol in reversed(word[: len(word) - shared]):
                    path.append(node(symbol, path[-1]))
                last = word
                out.append((word, path[-1][0][START], audit_of(word, path)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["word", "cost", "audit"])

    return arrow_map(ordered, rows, "word string, cost bigint, audit string")


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32(`conv_id:turn`) % 20; a null is one space, but in the columns conv_id and turn themselves."""
    one = F.lit(" ")
    code = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), one), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one)).cast("binary")) % 20
    named = rows.select("conv_id", "turn", F.coalesce("role", one).alias("role"), F.coalesce("text", one).alias("text"), code.alias("code")).where("code <> 0")
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("code") == 3, 2).otherwise(1)))
    return named.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def turns(rows: DataFrame) -> DataFrame:
    """rows with pos (from 1 in each conversation), symbol, broken (an illegal step from the turn before) and new_turn.

    One shuffle by conversation serves all windows; they stream through a task and spill.
    """
    same = Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text", "seen")
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    fault = F.when(end == "", "blank").when(F.col("seen") > 1, "duplicate").when(~F.substring(end, -1, 1).isin(".", "!", "?"), "truncated")
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    step = F.concat(F.lag(initial).over(order), initial)
    # Distinct turns are counted where they begin; nulls come first and begin none.
    begins = F.col("turn").isNotNull() & ~F.coalesce(F.lag("turn").over(order) == F.col("turn"), F.lit(False))
    dealt = rows.repartition("conv_id").withColumn("seen", F.row_number().over(same)).withColumn("fault", fault)
    return dealt.select(
        "conv_id", "turn", "role", "text", "fault", F.row_number().over(order).alias("pos"), symbol.alias("symbol"), (step.isNotNull() & ~step.isin("su", "ua", "au")).alias("broken"), begins.alias("new_turn")
    )


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: rows are turns with the audit at pos 1, and stream through in order; nothing but the hash is held."""
    small = rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos").select("conv_id", "pos", "role", "text", "audit")
    kind = small.schema["conv_id"].dataType.simpleString()

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, audit, at, state, begun, now = None, "", 0, START, False, None

        def put(role: str, text: str) -> None:
            nonlocal begun
            digest.update((("\n" if begun else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            begun = True

        def inserts() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state = NEXT[state]
                put(ROLE[state], "")
                at += 1

        for b in batches:
            ids, out = b.column("conv_id"), ([], [])

            def close(out: tuple = out) -> None:
                if digest is not None:
                    inserts()
                    out[0].append(now)
                    out[1].append(digest.hexdigest())

            for k, (pos, role, text, edits) in enumerate(zip(*(b.column(c).to_pylist() for c in ("pos", "role", "text", "audit")), strict=True)):
                if pos == 1:
                    close()
                    digest, audit, at, state, begun, now = hashlib.sha256(), edits, 0, START, False, ids[k].as_py()
                inserts()
                if audit[at] == "K":
                    state = _moved(state, role[:1])
                    put(role, text)
                elif audit[at] == "R":
                    state = NEXT[state]
                    put(ROLE[state], text)
                at += 1
            yield pa.RecordBatch.from_arrays([pa.array(out[0], ids.type), pa.array(out[1], pa.string())], ["conv_id", "repaired_sha256"])
        if digest is not None:
            out = ([], [])
            close(out)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], ids.type), pa.array(out[1], pa.string())], ["conv_id", "repaired_sha256"])

    return arrow_map(small, stream, f"conv_id {kind}, repaired_sha256 string")


def repair(damaged: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for every conv_id of ids: gaps, faults, illegal steps, cost, audit and hash of the repaired turns.

    Turns are taken by turn (nulls first), role and text, so equal ones stand together and only the
    first of them is no duplicate. A role counts by its first letter; an empty or unknown one can't be
    kept. A null conv_id is a conversation like any other; one without turns has zeros, an empty audit
    and the hash of nothing, and an empty table gives no rows. The words of roles and faults hold a
    byte for each turn; texts of a conversation are never gathered, but its hash makes them pass
    through one task in order. Other columns are ignored.
    """
    rows = materialise(turns(damaged), "turns")
    is_ = lambda f: F.sum((F.col("fault") == f).cast("long"))
    marks = F.array_sort(F.collect_list(F.struct("pos", "symbol")))
    convs = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.sum(F.col("new_turn").cast("long")), F.lit(0)).cast("long").alias("gaps"),
        *(F.coalesce(is_(f), F.lit(0)).alias(f) for f in ("blank", "duplicate", "truncated")), F.sum(F.col("broken").cast("long")).alias("illegal"), F.array_join(F.transform(marks, lambda x: x["symbol"]), "").alias("word"),
    )
    convs = materialise(convs, "words")
    solved = sized(materialise(solve(convs), "solved"))
    convs = materialise(convs.join(solved, "word").drop("word"), "convs")
    begun = rows.select(F.col("conv_id").alias("conv"), "pos", "role", "text").join(convs.select("conv_id", F.col("audit").alias("edits")), F.col("conv").eqNullSafe(F.col("conv_id")))
    hashes = repaired(begun.select("conv_id", "pos", "role", "text", F.when(F.col("pos") == 1, F.col("edits")).alias("audit")))
    every = ids.select(F.col("conv_id").alias("id")).distinct()
    out = every.join(convs, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").join(hashes, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(F.col("id").alias("conv_id"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    return repair(damage(rows), rows)


def _plus(v: str, cost: str, letter: str) -> str:
    """SQL: an edit in front of a state's value, which is its cost in nine digits and its audit."""
    return f"lpad((substr({v}, 1, 9)::bigint + {cost})::varchar, 9, '0') || '{letter}' || substr({v}, 10)"


def _ways(state: int) -> str:
    extra = "case when truncated then 3 else 0 end"
    to, role = f"d.v{NEXT[state]}", {USER: "u", ASSISTANT: "a"}[NEXT[state]]
    ways = [_plus(f"d.v{state}", "4", "D"), f"case when not gone then {_plus(to, f'3 + {extra}', 'R')} end", f"case when not gone and initial = '{role}' then {_plus(to, extra, 'K')} end"]
    if state == START:
        ways.append(f"case when not gone and initial = 's' then {_plus('d.v1', extra, 'K')} end")
    return f"list_min([{', '.join(ways)}])"


QUERIES = {"op12_conversation_repair": op12_conversation_repair}
ORACLE = {
    "op12_conversation_repair": rf"""
        with recursive t as (
            select list(v order by i) as crcs
            from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) as v from (select unnest(range(256)) as i))),
        k as (
            select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
        m as (
            select k.*, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::bigint)),
                                        lambda c, b: xor(crcs[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 as code
            from k, t),
        r as (
            select conv_id, turn, case when code = 4 then 'user' else role end as role,
                   case code when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
                   unnest(case when code = 3 then [1, 2] else [1] end) as copy
            from m where code <> 0),
        n as (
            select *, left(role, 1) as initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as cut,
                   row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen,
                   row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as pos,
                   lag(left(role, 1)) over (partition by conv_id order by turn nulls first, role, text, copy) as before
            from r),
        f as (
            select *, cut = '' as blank, cut <> '' and seen > 1 as duplicate, cut = '' or seen > 1 as gone,
                   cut <> '' and seen = 1 and right(cut, 1) not in ('.', '!', '?') as truncated,
                   coalesce(before || initial not in ('su', 'ua', 'au'), false) as illegal
            from n),
        c as (
            select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank,
                   count(*) filter (duplicate) as duplicate, count(*) filter (truncated) as truncated, count(*) filter (illegal) as illegal
            from f group by conv_id),
        dp as (
            select conv_id, n + 1 as pos, '000000000' as v0, '000000006II' as v1, '000000003I' as v2, '000000000' as v3 from c
            union all
            select conv_id, pos, least(b0, {_plus(f"least(b2, {_plus('b3', '3', 'I')})", '3', 'I')}), least(b1, {_plus(f"least(b2, {_plus('b3', '3', 'I')})", '3', 'I')}),
                   least(b2, {_plus('b3', '3', 'I')}), least(b3, {_plus('b2', '3', 'I')})
            from (select f.conv_id, f.pos, {_ways(0)} as b0, {_ways(1)} as b1, {_ways(2)} as b2, {_ways(3)} as b3
                  from dp d join f on f.conv_id is not distinct from d.conv_id and f.pos = d.pos - 1)),
        a as (select conv_id, substr(v0, 1, 9)::bigint as cost, substr(v0, 10) as audit from dp where pos = 1),
        w as (
            select conv_id, audit, 1 as nth, 1 as pos, 'a' as last, []::varchar[] as done from a
            union all
            select w.conv_id, audit, nth + 1, w.pos + case when e = 'I' then 0 else 1 end, case when e = 'D' then last when e = 'K' then f.initial else role2[1] end,
                   case e when 'D' then done when 'K' then list_append(done, f.role || ':' || f.text) when 'R' then list_append(done, role2 || ':' || f.text) else list_append(done, role2 || ':') end
            from (select *, substr(audit, nth, 1) as e, case when last = 'u' then 'assistant' else 'user' end as role2 from w where nth <= length(audit)) w
            left join f on f.conv_id is not distinct from w.conv_id and f.pos = w.pos and e <> 'I'),
        h as (select conv_id, sha256(coalesce(array_to_string(done, chr(10)), '')) as h from w where nth = length(audit) + 1)
        select i.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
               coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, coalesce(h, sha256('')) as repaired_sha256
        from (select distinct conv_id from conversations) i
        left join c on c.conv_id is not distinct from i.conv_id left join a on a.conv_id is not distinct from i.conv_id left join h on h.conv_id is not distinct from i.conv_id"""
}
