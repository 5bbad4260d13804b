"""Repair of conversations by the cheapest edits, solved once for every distinct signature.

A conversation's turns become a string of one sign each, which says the role and the
fault.  Distinct strings are solved once, by recursion over (place, state) with a memo;
the audits (one letter an edit) join back and are replayed over the turns.  What is
joined and replayed is small: the turns of a conversation are read in order from sorted
partitions, so neither their texts nor their edits are ever held as a whole.

Signs: ``s``, ``u``, ``a`` and ``o`` (any other role) are sound turns, capital letters
truncated ones, ``d`` blank or repeated ones, which must go.  Repaired roles read
``(s?(ua)+)?``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaro.llm._work import join_on, settle

#: What edits cost; an undeleted truncated turn costs TRUNCATED more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: The role that each state takes next and the state after it: nothing yet, after s, after u, after ua.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
#: A signature is common if more than one conversation of so many has it: at most as many signatures are.
COMMON = 5_000
#: What a blank text consists of.
WHITE = " \t\n\x0b\f\r"


def repair(signature: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits; of equal costs the audit that comes first."""
    n = len(signature)
    memo: dict[tuple[int, int, int], float] = {}

    def options(i: int, q: int, k: int) -> Iterator[tuple[str, int, int, int, int]]:
        """Edits at place i in state q after k insertions there, in order of letters: (letter, cost, place, state, insertions).

        Three insertions in a row come back to a state, so no cheapest repair has them.
        """
        sign = signature[i] if i < n else ""
        given = NEXT[q].get("u", NEXT[q].get("a"))
        if sign:
            yield "D", DELETE, i + 1, q, 0
        if k < 2:
            yield "I", INSERT, i, given, k + 1
        if sign and sign != "d":
            more = TRUNCATED if sign.isupper() else 0
            if sign.lower() in NEXT[q]:
                yield "K", KEEP + more, i + 1, NEXT[q][sign.lower()], 0
            yield "R", REROLE + more, i + 1, given, 0

    def cost(i: int, q: int, k: int = 0) -> float:
        """Cheapest way to the end."""
        if (i, q, k) not in memo:
            end = 0 if i == n and q in ENDS else float("inf")
            memo[i, q, k] = min([end, *(c + cost(*to) for _, c, *to in options(i, q, k))])
        return memo[i, q, k]

    for i in range(n, 0, -1):  # from the end, so that the recursion stays shallow at any length
        for q in range(len(NEXT)):
            cost(i, q)
    audit, at = [], (0, 0, 0)
    while cost(*at) or at[0] < n:
        letter, at = next((x, tuple(to)) for x, c, *to in options(*at) if c + cost(*to) == cost(*at))
        audit.append(letter)
    return int(cost(0, 0)), "".join(audit)


def faults(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text, copy) without nulls in role and text, with ``key`` (of the text), ``initial`` and ``fault``.

    Turns go by turn (nulls first), role, key and copy.  A turn's first fault counts:
    blank, duplicate (role and text seen earlier), truncated (no stop at its end).
    """
    initial = F.coalesce(F.nullif(F.substring("role", 1, 1), F.lit("")), F.lit(" "))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "key").orderBy(F.col("turn").asc_nulls_first(), "copy")) > 1
    last = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    kind = F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated").otherwise("sound")
    small = turns.select("conv_id", "turn", "role", F.md5("text").alias("key"), "copy", initial.alias("initial"), kind.alias("fault"))
    return small.withColumn("fault", F.when((F.col("fault") != "blank") & seen, "duplicate").otherwise(F.col("fault")))


def signatures(turns: DataFrame) -> DataFrame:
    """Per conversation: conv_id, initials and signature (strings of a sign a turn), blank, duplicate, truncated, gaps, illegal.

    Turns are ordered in ranges of (conv_id, turn), so a conversation of very many turns is
    put together from a string for each range.
    """
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    sign = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    ranged = faults(turns).withColumn("sign", sign).repartitionByRange("conv_id", "turn", "role", "key").withColumn("part", F.spark_partition_id())
    row = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "key", "copy", (F.col("fault") == "duplicate").alias("again"), "initial", "sign")
    count = lambda name: F.count_if(F.col("fault") == name).alias(name)
    pieces = ranged.groupBy("conv_id", "part").agg(
        F.array_sort(F.collect_list(row)).alias("rows"), count("blank"), count("duplicate"), count("truncated"), F.min("turn").alias("least"), F.max("turn").alias("most"),
    )
    joined = lambda of, name: F.array_join(F.col(f"{of}.{name}"), "")
    turns_in = F.size(F.array_distinct(F.filter("rows.turn", lambda t: t.isNotNull())))
    pieces = pieces.select("*", joined("rows", "initial").alias("initial"), joined("rows", "sign").alias("sign"), turns_in.alias("turns"))
    whole = pieces.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("part", "initial", "sign", "least", "most"))).alias("parts"),
        F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated"),
        (F.max("most") - F.min("least") + 1 - F.sum("turns")).alias("gaps"),
    )
    whole = whole.withColumn("initials", joined("parts", "initial")).withColumn("signature", joined("parts", "sign"))
    # A turn number that goes on in the next range was counted in both.
    again = F.expr("size(filter(sequence(1, size(parts)), i -> get(parts, i).least = get(parts, i - 1).most))")
    legal = F.regexp_count("initials", F.lit("(?=su|ua|au)"))
    return whole.select(
        "conv_id", "initials", "signature", "blank", "duplicate", "truncated", F.coalesce(F.col("gaps") + again, F.lit(0)).alias("gaps"),
        (F.length("initials") - 1 - legal).cast("long").alias("illegal"),
    )


def solve(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, signature, ...), a settled table, with cost and audit: each distinct signature is solved once."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [repair(s) for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], ["signature", "n", "cost", "audit"]
            )

    distinct = conversations.groupBy("signature").agg(F.count("*").alias("n"))
    solved = settle(distinct.mapInArrow(answer, "signature string, n long, cost long, audit string"))
    total = conversations.count()
    # At most COMMON signatures of at most 1,000 signs: some megabytes.  They are joined without a shuffle, and what remains has no common key.
    common = (F.col("n") * COMMON > total) & (F.length("signature") <= 1000)
    met = conversations.join(F.broadcast(solved.where(common).drop("n")), "signature", "left")
    rest = met.where("audit is null").drop("cost", "audit").join(solved.where(~common).drop("n"), "signature")
    return met.where("audit is not null").unionByName(rest)


def replay(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit, role, text; a conversation's rows lie together and in order in one partition.

    A conversation's audit travels ahead of its turns, sorted with them, so that only
    its letters are held while its turns stream by.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, letters, at, state, place = None, "", 0, 0, 0
        out: list[tuple] = []

        def insert() -> None:
            """The insertions that come next in the audit."""
            nonlocal at, state, place
            while at < len(letters) and letters[at] == "I":
                give("I", None, "")

        def give(letter: str, role: str | None, text: str) -> None:
            nonlocal at, state, place
            if role is None:
                state = NEXT[state].get("u", NEXT[state].get("a"))
                role = "assistant" if state == 3 else "user"
            else:
                state = NEXT[state][role[:1]]
            out.append((conv, place, letter, role, text))
            at, place = at + 1, place + 1

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 5, schema)], schema=schema)
            out.clear()
            return made

        for batch in batches:
            for conv_id, audit, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if audit is not None:
                    conv, letters, at, state, place = conv_id, audit, 0, 0, 0
                    insert()
                    continue
                if letters[at] == "D":
                    at += 1
                elif letters[at] == "K":
                    give("K", role, text)
                else:
                    give("R", None, text)
                insert()
            yield batch_of()

    ahead = audits.select("conv_id", "audit", *[F.lit(None).cast(t).alias(c) for c, t in (("role", "string"), ("text", "string"), ("turn", "long"), ("copy", "int"))])
    rows = turns.select("conv_id", F.lit(None).cast("string").alias("audit"), "role", "text", F.col("turn").cast("long").alias("turn"), "copy")
    both = ahead.unionByName(rows).repartition("conv_id")
    order = [F.col("conv_id"), F.col("audit").isNull(), F.col("turn").asc_nulls_first(), F.col("role"), F.md5("text"), F.col("copy")]
    ordered = both.sortWithinPartitions(*order).select("conv_id", "audit", "role", "text")
    return ordered.mapInArrow(edit, "conv_id long, place long, edit string, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the lines ``role:text`` of replay's rows, which stream by in order."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None
        for batch in batches:
            done: tuple[list, list] = ([], [])
            for conv_id, place, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if place == 0:
                    if digest is not None:
                        done[0].append(conv), done[1].append(digest.hexdigest())
                    conv, digest = conv_id, hashlib.sha256()
                digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(done, schema)], schema=schema)
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()])], schema=schema)

    return repaired.mapInArrow(fold, "conv_id long, repaired_sha256 string")


def filled(conversations: DataFrame, copy: Column | None = None) -> DataFrame:
    """The turns that operators here read: a null role or text is a space; copy tells rows alike in all else apart."""
    space = lambda c: F.coalesce(conversations[c].cast("string"), F.lit(" ")).alias(c)
    return conversations.select(conversations["conv_id"].cast("long"), conversations["turn"].cast("long"), space("role"), space("text"), (F.lit(0) if copy is None else copy).alias("copy"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The turns with faults planted by crc32 of ``conv_id:turn``: dropped, emptied, without stops, repeated, given to the user."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = filled(conversations).withColumn("plant", F.crc32(name) % 20).where("plant <> 0")
    text = F.when(F.col("plant") == 1, "").when(F.col("plant") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("plant") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("plant") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def audit_conversations(turns: DataFrame) -> DataFrame:
    """Per conversation of turns (see ``filled``): conv_id, initials, signature, blank, duplicate, truncated, gaps, illegal, cost, audit."""
    return solve(settle(signatures(turns)))


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """Repaired conversations: conv_id, place, edit (K, R or I), role, text.

    Null roles and texts count as one space, so they are blank or of another role; null
    conv_ids are one conversation, null turns come first, turns of one number go by role,
    then by the md5 of their texts; repeated rows are duplicates.  A conversation of which
    nothing stays has no row; no rows in, none out.  Other columns are not read.
    """
    turns = filled(conversations)
    return replay(turns, audit_conversations(turns))


def repair_report(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """What ails and mends every conv_id of conversations, once turns are all that is left of them; nothing left gives zeros and an empty audit."""
    found = settle(audit_conversations(turns))
    hashes = digests(replay(turns, found))
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = join_on(join_on(ids, found, ["conv_id"], "left"), hashes, ["conv_id"], "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256().hexdigest())
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
