"""Conversations with damaged structure, and the cheapest edits that mend them.

Every row becomes one symbol: the class of its role, whether it is truncated, or that it
has to go. A conversation's symbols are its signature. All distinct signatures are read
from their ends, in the order of their reversed symbols, which walks the automaton of
their shared suffixes depth first: a suffix that several signatures have is one node, and
for each node and grammar state the cost of the rest and the first letter of its best
audit are worked out once. Only the nodes on the way to the current signature are held.

At one place no two edits of a grammar state have the same letter and each leads to one
state, so among equal costs the smaller first letter gives the smaller audit, and the
audit is read off by following first letters.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinshelf.session import cut_lineage

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: Costs of the edits. A truncated row that stays costs one more.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1

# Grammar states: nothing yet, after a system, user and assistant row. ``(s?(ua)+)?``
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
#: The state that an inserted or renamed row leads to, and its role.
FILLED = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Costs of the rest and first letters where no row is left.
END = (0, 2 * INSERT, INSERT, 0), ("", "I", "I", "")
#: A symbol for a row that has to go; others are s, u, a or o, as capitals where truncated.
GONE = "d"


@lru_cache(maxsize=1 << 16)
def _step(rest: tuple[int, ...], symbol: str) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """Costs and first letters of the node before ``symbol``, from the costs of the node after it."""
    late, role = TRUNCATED * symbol.isupper(), symbol.lower()
    best = []
    for state in range(4):
        options = [(DELETE + rest[state], "D")]
        if symbol != GONE:
            options.append((REROLE + late + rest[FILLED[state]], "R"))
            kept = AFTER.get(role, (None,) * 4)[state]
            if kept is not None:
                options.append((late + rest[kept], "K"))
        best.append(min(options))
    # a second insertion in a row only pays on the way from nothing or a system row
    answered = [best[USER], best[ASSISTANT]]
    best[USER] = min(answered[0], (INSERT + answered[1][0], "I"))
    best[ASSISTANT] = min(answered[1], (INSERT + answered[0][0], "I"))
    for state in (NOTHING, SYSTEM):
        best[state] = min(best[state], (INSERT + best[USER][0], "I"))
    return tuple(c for c, _ in best), tuple(letter for _, letter in best)


def edits(nodes: list, signature: str) -> str:
    """The best audit of a signature; ``nodes[k]`` stands before its last ``k`` symbols."""
    state, left, letters = NOTHING, len(signature), []
    while letter := nodes[left][1][state]:
        letters.append(letter)
        if letter == "K":
            state = AFTER[signature[-left].lower()][state]
        elif letter != "D":
            state = FILLED[state]
        left -= letter != "I"
    return "".join(letters)


def _audits(batches):
    """``(signature, cost, audit)``; signatures come in the order of their reversed symbols."""
    before, nodes, base = "", [END], [0]
    for batch in batches:
        signatures = batch.column(0).to_pylist()
        costs, audits = [], []
        for signature in signatures:
            shared, most = 0, min(len(signature), len(before))
            while shared < most and signature[-1 - shared] == before[-1 - shared]:
                shared += 1
            del nodes[shared + 1 :], base[shared + 1 :]
            for symbol in reversed(signature[: len(signature) - shared]):
                made, letters = _step(nodes[-1][0], symbol)
                low = min(made)  # nodes that differ by a constant only are one entry of the table
                nodes.append((tuple(c - low for c in made), letters))
                base.append(base[-1] + low)
            before = signature
            costs.append(base[-1] + nodes[-1][0][NOTHING])
            audits.append(edits(nodes, signature))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(costs, pa.int64()), pa.array(audits, pa.string())],
            names=["signature", "cost", "audit"],
        )


def audits_of(signatures: DataFrame) -> DataFrame:
    """``(signature, cost, audit)`` of each distinct ``signature``.

    Signatures are dealt out by ranges of their last symbols, and by a hash where very many
    end alike; only the nodes at the border of two ranges are worked out twice.
    """
    backwards = F.reverse("signature")
    distinct = signatures.select("signature").distinct().withColumn("backwards", backwards)
    ordered = distinct.repartitionByRange(F.substring("backwards", 1, 32), F.xxhash64("signature"))
    rows = ordered.sortWithinPartitions("backwards").select("signature")
    return cut_lineage(rows.mapInArrow(_audits, "signature string, cost long, audit string"))


# --- From rows to signatures


def damaged(turns: DataFrame) -> DataFrame:
    """``conversations`` with known damage, by a checksum of conversation and turn.

    One in twenty checksums each: the row goes, loses its text, loses its sentence marks,
    comes twice, or becomes the user's. Nulls are one space, in ``conv_id`` and ``turn``
    for the checksum only.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(parts[0], F.lit(":"), parts[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return (
        turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("damage"))
        .where("damage != 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("damage") == 1, "")
            .when(F.col("damage") == 2, F.translate("text", ENDS, ""))
            .otherwise(F.col("text"))
            .alias("text"),
            F.explode(F.array_repeat(F.lit(0), F.when(F.col("damage") == 3, 2).otherwise(1))).alias("copy"),
        )
        .drop("copy")
    )


def _in_order(prefix: list[str] | None = None) -> list[Column]:
    before = [F.col(c) for c in prefix or []]
    return [F.col("conv_id"), *before, F.col("turn").asc_nulls_first(), F.col("role"), F.col("h1"), F.col("h2")]


def _hashed(turns: DataFrame) -> DataFrame:
    return turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).select("*", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))


def _parts(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


SIGNED = "signature string, gaps long, blank long, duplicate long, truncated long, illegal long"
LEGAL = ("su", "ua", "au")


class _Signature:
    def __init__(self, conv):
        self.conv, self.symbols = conv, []
        self.turns, self.low, self.high, self.turn = 0, None, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial = None

    def add(self, turn, role, fault, fresh, n):
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.turns, self.turn, self.high = self.turns + 1, turn, turn
        initial = role[:1]
        again = n - (fault != "blank" and fresh)  # copies that have to go
        if fault == "blank":
            self.blank += n
        else:
            self.duplicate += again
            self.truncated += fault == "truncated" and fresh
            if fresh:
                symbol = initial if initial in ("s", "u", "a") else "o"
                self.symbols.append(symbol.upper() if fault == "truncated" else symbol)
        self.symbols.append(GONE * again)
        self.illegal += self.initial is not None and self.initial + initial not in LEGAL
        self.illegal += (n - 1) * (initial + initial not in LEGAL)
        self.initial = initial

    def row(self):
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (
            self.conv, "".join(self.symbols), gaps, self.blank, self.duplicate, self.truncated, self.illegal,
        )


def _signatures(batches):
    """One row per conversation, for rows that come conversation by conversation in order."""
    held, kind = None, None

    def rows(done):
        columns = list(zip(*(d.row() for d in done))) or [[]] * 7
        kinds = (kind, pa.string(), *[pa.int64()] * 5)
        names = ["conv_id", *(x.split()[0] for x in SIGNED.split(", "))]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=names)

    for batch in batches:
        done, kind = [], batch.column(0).type
        for conv, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            if held is None or held.conv != conv:
                done += [held] if held else []
                held = _Signature(conv)
            held.add(*rest)
        yield rows(done)
    if held:
        yield rows([held])


def signatures(turns: DataFrame) -> DataFrame:
    """``(conv_id, signature, gaps, blank, duplicate, truncated, illegal)`` of each conversation.

    Texts do not move: rows are compared by 128 bits of their text, equal ones are counted
    before they are shuffled, and the first row of each role and text is a minimum.
    """
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(bare == "", "blank").when(~F.right(bare, F.lit(1)).isin(*ENDS), "truncated").otherwise("")
    same = ["conv_id", "role", "h1", "h2"]
    # written, so that Spark can split the join at a text that one conversation says very often
    counted = cut_lineage(
        _hashed(turns)
        .withColumn("fault", fault)
        .groupBy(*same, "turn")
        .agg(F.first("fault").alias("fault"), F.count(F.lit(1)).alias("n"))
    )
    place = F.struct(F.col("turn").isNotNull(), "turn")
    first = cut_lineage(counted.groupBy(*same).agg(F.min(place).alias("first")))
    keys = [F.col(f"c.{k}").eqNullSafe(F.col(f"f.{k}")) for k in same]
    met = counted.alias("c").join(first.alias("f"), keys).select(
        *[f"c.{k}" for k in same], "turn", "fault", "n", F.col("first.turn").eqNullSafe(F.col("turn")).alias("fresh")
    )
    ordered = met.repartition(_parts(turns), "conv_id").sortWithinPartitions(*_in_order())
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = ordered.select("conv_id", "turn", "role", "fault", "fresh", "n")
    return cut_lineage(rows.mapInArrow(_signatures, f"conv_id {kind}, {SIGNED}"))


# --- From audits to mended conversations

TOLD = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _mend(batches):
    """Rows after the edits. A conversation's first row has its audit as text and comes back as it is."""
    audit, at, state = "", 0, NOTHING
    for batch in batches:
        head, roles, texts = (batch.column(k).to_pylist() for k in ("head", "role", "text"))
        source, positions, out_roles, out_texts = [], [], [], []

        def put(row, position, role, text):
            source.append(row)
            positions.append(position)
            out_roles.append(role)
            out_texts.append(text)

        for i, (first, role, text) in enumerate(zip(head, roles, texts)):
            if first:
                audit, at, state, position = text, 0, NOTHING, 0
                put(i, -1, None, text)
            else:
                letter, at = audit[at], at + 1
                if letter == "K":
                    state = AFTER[role[:1]][state]
                elif letter == "R":
                    state = FILLED[state]
                    role = ROLES[state]
                if letter != "D":
                    put(i, position, role, text)
                    position += 1
            # insertions follow at once, also those after the last row
            while audit[at : at + 1] == "I":
                state, at = FILLED[state], at + 1
                put(i, position, ROLES[state], "")
                position += 1
        rows = pa.array(source, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(rows),
                pa.array(positions, pa.int64()),
                pa.array(out_roles, pa.string()),
                pa.array(out_texts, pa.string()),
                *(batch.column(k).take(rows) for k in TOLD),
            ],
            names=["conv_id", "position", "role", "text", *TOLD],
        )


def mended_conversations(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """``(conv_id, position, role, text, gaps, blank, duplicate, truncated, illegal, cost)`` after the edits.

    ``turns(conv_id, turn, role, text)``: rows go by ``turn``, null first, equal ones by role
    and then a hash of the text. Position -1 has a row for each conversation, also of
    ``conversations(conv_id)`` without any row, with what is told of it and its audit as
    text. A null role or text is empty, null ids are one conversation, repeated rows are
    duplicates, other columns are left out. Rows of a conversation come in order within one
    partition, sorted and not held; its signature and audit, a byte a row, are one value each.
    """
    signed = signatures(turns)
    audits = audits_of(signed)
    judged = cut_lineage(signed.join(audits, "signature").drop("signature"))
    if conversations is not None:
        every = conversations.select(F.col("conv_id").alias("_id")).distinct()
        judged = every.join(judged, F.col("_id").eqNullSafe(F.col("conv_id")), "left").select(
            F.col("_id").alias("conv_id"), *[c for c in judged.columns if c != "conv_id"]
        )
    heads = judged.select(
        "conv_id",
        F.lit(True).alias("head"),
        F.coalesce("audit", F.lit("")).alias("text"),
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in TOLD],
    )
    rows = _hashed(turns).withColumn("head", F.lit(False))
    ordered = (
        heads.unionByName(rows, allowMissingColumns=True)
        .repartition(_parts(turns), "conv_id")
        .sortWithinPartitions("conv_id", F.desc("head"), *_in_order()[1:])
        .select("conv_id", "head", "role", "text", *TOLD)
    )
    kind = turns.schema["conv_id"].dataType.simpleString()
    told = ", ".join(f"{c} long" for c in TOLD)
    return ordered.mapInArrow(_mend, f"conv_id {kind}, position long, role string, text string, {told}")


def digests(mended: DataFrame) -> DataFrame:
    """A row per conversation: what is told of it, ``audit`` and ``repaired_sha256``, in the order of the rows."""
    kind = mended.schema["conv_id"].dataType.simpleString()

    def each(batches):
        held = arrow = None

        def rows(done):
            columns = list(zip(*((*told, audit, sha.hexdigest()) for told, audit, sha in done))) or [[]] * 9
            kinds = (arrow, *[pa.int64()] * 6, pa.string(), pa.string())
            names = ["conv_id", *TOLD, "audit", "repaired_sha256"]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=names)

        for batch in batches:
            done, arrow = [], batch.column(0).type
            convs, positions, roles, texts, *told = (c.to_pylist() for c in batch.columns)
            for i, position in enumerate(positions):
                if position < 0:
                    done += [held] if held else []
                    held = (convs[i], *(t[i] for t in told)), texts[i], hashlib.sha256()
                else:
                    held[2].update(f"{chr(10) if position else ''}{roles[i]}:{texts[i]}".encode())
            yield rows(done)
        if held:
            yield rows([held])

    told = ", ".join(f"{c} long" for c in TOLD)
    return mended.mapInArrow(each, f"conv_id {kind}, {told}, audit string, repaired_sha256 string")


def op12_suffix_dawg(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return digests(mended_conversations(damaged(turns), turns))


def _sql_more(entry: str, cost: str | int, letter: str) -> str:
    """An entry, six digits of cost and an audit, with one more edit in front."""
    return f"lpad((({entry})[1:6]::INTEGER + {cost})::VARCHAR, 6, '0') || '{letter}' || ({entry})[7:]"


def _sql_step() -> str:
    """Entries of all grammar states before the symbol ``x[1]``, from those after it in ``v``."""
    late = f"CASE WHEN x[1] IN ('S', 'U', 'A', 'O') THEN {TRUNCATED} ELSE 0 END"
    base = []
    for state in range(4):
        options = [_sql_more(f"v[{state + 1}]", DELETE, "D")]
        renamed = _sql_more(f"v[{FILLED[state] + 1}]", f"{REROLE} + {late}", "R")
        options.append(f"CASE WHEN x[1] != '{GONE}' THEN {renamed} END")
        for role, after in AFTER.items():
            if after[state] is not None:
                options.append(f"CASE WHEN lower(x[1]) = '{role}' THEN {_sql_more(f'v[{after[state] + 1}]', late, 'K')} END")
        base.append(f"least({', '.join(options)})")
    user, assistant = (f"least(b[{a + 1}], {_sql_more(f'b[{b + 1}]', INSERT, 'I')})" for a, b in ((USER, ASSISTANT), (ASSISTANT, USER)))
    first = [f"least(b[{s + 1}], {_sql_more(user, INSERT, 'I')})" for s in (NOTHING, SYSTEM)]
    return f"list_transform([[{', '.join(base)}]], lambda b: [{first[0]}, {first[1]}, {user}, {assistant}])[1]"


_SQL_END = ", ".join(f"'{cost:06d}{'I' * (cost // INSERT)}'" for cost in END[0])
_SQL_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP12_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations
), hit AS (
  SELECT *, xor(list_reduce([ascii(x)::BIGINT FOR x IN string_split(key, '')],
      lambda c, y: list_reduce(range(8),
          lambda d, i: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END, xor(c, y)),
      4294967295::BIGINT), 4294967295) % 20 AS damage
  FROM said
), damaged AS (
  SELECT conv_id, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role,
         CASE damage WHEN 1 THEN '' WHEN 2 THEN translate(text, '{ENDS}', '') ELSE text END AS text,
         unnest(range(CASE damage WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hit WHERE damage != 0
), ordered AS (
  SELECT *, left(role, 1) AS initial, rtrim(text, {_SQL_BLANKS}) AS bare,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
  FROM damaged
), marked AS (
  SELECT *, CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END AS class,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial AS pair,
         CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
              WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM ordered
), told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
         list([CASE WHEN fault IN ('blank', 'duplicate') THEN '{GONE}' WHEN fault = 'truncated' THEN upper(class)
                    ELSE class END] ORDER BY place DESC) AS symbols
  FROM marked GROUP BY conv_id
), solved AS (
  SELECT *, list_reduce(symbols, lambda v, x: {_sql_step()}, [{_SQL_END}])[1] AS best FROM told
), letters AS (
  SELECT conv_id, best[7:] AS audit, unnest(range(1, len(best) - 5)) AS j FROM solved
), edits AS (
  SELECT l.conv_id, j, audit[j] AS letter, len(replace(audit[:j], 'D', '')) AS emitted, m.role, m.text, m.initial
  FROM letters l LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM l.conv_id AND audit[j] != 'I'
       AND m.place = len(replace(audit[:j], 'I', ''))
), begun AS (
  SELECT *, max(CASE WHEN emitted = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END)
              OVER (PARTITION BY conv_id) AS led
  FROM edits
), mended AS (
  SELECT conv_id, string_agg(
      CASE WHEN letter = 'K' THEN role WHEN (emitted - led) % 2 = 1 THEN 'user' ELSE 'assistant' END
      || ':' || CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS repaired
  FROM begun WHERE letter != 'D' GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best[:6]::BIGINT, 0) AS cost,
       coalesce(best[7:], '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
     LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
     LEFT JOIN mended m ON m.conv_id IS NOT DISTINCT FROM c.conv_id
"""
