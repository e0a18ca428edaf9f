"""Repair of conversation structure: cheapest edits to a legal order of roles, found once for each shared suffix.

A conversation is a signature, one letter for each row's role and fault. Signatures are minimised from the end: all with a
common ending share that ending's nodes of an acyclic word graph, and a node knows, for each state of the grammar, the cost to go
and the first edit of the best audit to its end, so that the best audit of a signature is a walk. Signatures sorted by their
reverse meet the graph depth first: a task keeps the nodes of one path, adds those that the last signature did not share, and so
prices each once; only the path at a border between two tasks is priced in both.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.ranking import ranked
from tidemark.llm.scratch import Scratch
from tidemark.llm.textkit import text_slices

_LETTERS = "ABCDEFGHIJKLMNOP"  # four faults for each of four initials
_INITIALS = "suax"  # x: any other
_FINE, _BLANK, _DUPLICATE, _TRUNCATED = range(4)
#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a. Which state each initial leads to, and which the role due does.
_KEEPS = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})
_DUE = (2, 2, 3, 2)
_DUE_ROLE = {2: "user", 3: "assistant"}
_LEGAL = {(0, 1), (1, 2), (2, 1)}
_DELETE, _REROLE, _INSERT, _CUT_OFF = 4, 3, 3, 3
_BLOCK = 1000  # places of a conversation whose letters are gathered at once
_SPACE = " \t\n\x0b\x0c\r"


class _Node(NamedTuple):
    """What is known of a suffix: for each state the cost to go and the first edit; counts of faults and illegal neighbours."""

    costs: tuple[int, ...]
    edits: tuple[str, ...]
    counts: tuple[int, int, int, int]


#: The empty suffix: legal after nothing and after an assistant, else what is due is inserted.
_END = _Node((0, 2 * _INSERT, _INSERT, 0), ("", "I", "I", ""), (0, 0, 0, 0))


def _parts(letter: str) -> tuple[int, int]:
    return divmod(_LETTERS.index(letter), 4)


def _before(letter: str, rest: _Node, following: str) -> _Node:
    """The node of ``letter`` and the suffix ``rest``, which begins with ``following``. Equal costs: the edit of the least letter."""
    role, fault = _parts(letter)
    extra = _CUT_OFF if fault == _TRUNCATED else 0
    best = []
    for state in range(4):
        options = [(rest.costs[state] + _DELETE, "D")]
        if fault not in (_BLANK, _DUPLICATE):
            if role in _KEEPS[state]:
                options.append((rest.costs[_KEEPS[state][role]] + extra, "K"))
            options.append((rest.costs[_DUE[state]] + extra + _REROLE, "R"))
        best.append(min(options))
    for _ in range(2):  # insertions before the row; a third would come back to a state
        best = [min(b, (best[_DUE[state]][0] + _INSERT, "I")) for state, b in enumerate(best)]
    illegal = bool(following) and (role, _parts(following)[0]) not in _LEGAL
    added = (fault == _BLANK, fault == _DUPLICATE, fault == _TRUNCATED, illegal)
    return _Node(tuple(c for c, _ in best), tuple(e for _, e in best), tuple(a + b for a, b in zip(rest.counts, added, strict=True)))


class SharedSuffixes:
    """The path of nodes of the signature met last, from its end; the next one shares its longest common ending."""

    def __init__(self):
        self.path, self.nodes, self.made = "", [_END], 0

    def solve(self, reverse: str) -> tuple[int, str, tuple[int, int, int, int]]:
        """Cost, audit and counts of the signature that reads ``reverse`` from its end."""
        shared = len(os.path.commonprefix([self.path, reverse]))
        del self.nodes[shared + 1 :]
        for k in range(shared, len(reverse)):
            self.nodes.append(_before(reverse[k], self.nodes[-1], reverse[k - 1] if k else ""))
            self.made += 1
        self.path = reverse
        depth, state, audit = len(reverse), 0, []
        while edit := self.nodes[depth].edits[state]:
            audit.append(edit)
            if edit == "I":
                state = _DUE[state]
                continue
            depth -= 1
            if edit != "D":
                state = _KEEPS[state][_parts(reverse[depth])[0]] if edit == "K" else _DUE[state]
        return self.nodes[-1].costs[0], "".join(audit), self.nodes[-1].counts


_SOLVED = "signature string, cost long, audit string, blank long, duplicate long, truncated long, illegal long"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = SharedSuffixes()
    for batch in batches:
        rows = []
        for reverse in batch.column("reverse").to_pylist():
            cost, audit, counts = known.solve(reverse)
            rows.append((reverse[::-1], cost, audit, *counts))
        names = [part.split()[0] for part in _SOLVED.split(", ")]
        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {n: [] for n in names})


def audits(signatures: DataFrame) -> DataFrame:
    """For each distinct ``signature`` its cost, its cheapest audit, and its faults: one walk over the shared suffixes."""
    reverse = signatures.select(F.reverse("signature").alias("reverse")).distinct()
    return reverse.repartitionByRange("reverse").sortWithinPartitions("reverse").mapInArrow(_solve, _SOLVED)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows (name, turn, role, text) after the damage that crc32 of ``conv_id:turn`` deals; nulls are one space there and in texts.

    ``name`` is conv_id as text, one space if null.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", filled("conv_id"), filled("turn")).cast("binary")) % 20
    rows = conversations.select(filled("conv_id").alias("name"), F.col("turn").cast("long").alias("turn"), filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.expr(r"CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '') ELSE text END")
    role = F.expr("if(kind = 4, 'user', role)")
    copies = F.explode(F.expr("if(kind = 3, array(0, 1), array(0))"))
    return rows.select("name", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def lettered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` (name, turn, role, text) with their ``place`` in the conversation, from 1, and the ``letter`` of role and fault.

    Order: turn, nulls first; equal turns by role and the text's SHA-256. Places are counted over ranges and the first of equal
    rows is a minimum, so that no conversation and no text is one task.
    """
    rows = rows.withColumn("sum", F.sha2("text", 256))
    placed = scratch.save(ranked(rows, "name", [F.struct(F.col("turn").isNotNull(), "turn"), F.col("role"), F.col("sum")], scratch, "place"))
    first = scratch.save(placed.groupBy("name", "role", "sum").agg(F.min("place").alias("first")))
    known = placed.join(first, ["name", "role", "sum"])
    last = F.right(F.rtrim("text", F.lit(_SPACE)), F.lit(1))
    fault = F.when(last == "", _BLANK).when(F.col("place") > F.col("first"), _DUPLICATE).when(~last.isin(".", "!", "?"), _TRUNCATED).otherwise(_FINE)
    initial = F.expr("CASE substring(role, 1, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END")
    letter = F.substring(F.lit(_LETTERS), (initial * 4 + fault + 1).cast("int"), F.lit(1))
    return scratch.save(known.select("name", "turn", "role", "text", "place", letter.alias("letter")))


def _joined(letters: Column, place: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("at"), letters.alias("l")))), lambda x: x["l"]), "")


def signatures(rows: DataFrame) -> DataFrame:
    """The signature of each ``name``: a letter for each row, gathered in blocks of places first; as long as its audit at most."""
    block = F.expr(f"place div {_BLOCK}")
    blocks = rows.groupBy("name", block.alias("block")).agg(_joined(F.col("letter"), F.col("place")).alias("part"))
    return blocks.groupBy("name").agg(_joined(F.col("part"), F.col("block")).alias("signature"))


class _Edits:
    """Applies an audit to a conversation's rows as they come."""

    def __init__(self):
        self.audit, self.at, self.state = "", 0, 0

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at, self.state = self.at + 1, _DUE[self.state]
            yield _DUE_ROLE[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.state = _KEEPS[self.state][_INITIALS.index(role[0])]
            yield role, text
        elif edit == "R":
            self.state = _DUE[self.state]
            yield _DUE_ROLE[self.state], text


_REPAIRED = "name string, role string, text string"


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of name and place; place 0 holds the audit in its text."""
    name, edits = None, _Edits()
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["name", "role", "text"])
    for batch in batches:
        for piece in text_slices(batch, "text"):
            out = []
            for key, place, role, text in zip(*(piece.column(c).to_pylist() for c in ("name", "place", "role", "text")), strict=True):
                if place == 0:
                    out.extend((name, *row) for row in edits.inserted())
                    name, edits = key, _Edits()
                    edits.audit = text
                else:
                    out.extend((name, *row) for row in edits.row(role, text))
            yield batch_of(out)
    yield batch_of([(name, *row) for row in edits.inserted()])


def repaired(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """The rows (name, role, text) after the edits of ``audited`` (name, audit), in order within a partition that holds all of a name's.

    A conversation passes through its task as a stream; what is held is its audit.
    """
    heads = audited.select("name", F.lit(0).cast("long").alias("place"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    both = heads.unionByName(rows.select("name", F.col("place").cast("long").alias("place"), "role", "text"))
    return both.repartition("name").sortWithinPartitions("name", "place").mapInArrow(_repair, _REPAIRED)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, digest = None, None
    for batch in batches:
        done = []
        for key, role, text in zip(*(batch.column(c).to_pylist() for c in ("name", "role", "text")), strict=True):
            if digest is None or key != name:
                if digest is not None:
                    done.append((name, digest.hexdigest()))
                name, digest = key, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_pydict({"name": pa.array([n for n, _ in done], pa.string()), "repaired_sha256": pa.array([d for _, d in done], pa.string())})
    if digest is not None:
        yield pa.RecordBatch.from_pydict({"name": [name], "repaired_sha256": [digest.hexdigest()]})


def repair(conversations: DataFrame, damage: bool = True) -> DataFrame:
    """Audit each conversation of (conv_id, turn, role, text): gaps, faults, the cheapest repair and a digest of its result.

    With ``damage`` rows are damaged first, as ``damaged`` says. Each row's first fault counts: blank, duplicate (role and text
    seen earlier), truncated. Keep costs 0, Rerole 3, Delete 4, Insert 3, a truncated row that stays 3; the cheapest edits that
    leave the initials ``(s?(ua)+)?``, of equally cheap ones the least text. Returns for each conv_id of the input, null included:
    gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Null roles and texts are one space, null turns come first and count in no gap; equal turns go by role and the text's
    SHA-256. Repeated rows are duplicates. A role of no letters has an initial that no place allows. Conversations that lost all
    rows have zeros, an empty audit and the digest of nothing. Other columns are not read; an empty table gives no rows.
    """
    scratch = Scratch(conversations.sparkSession, "repair")
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    if damage:
        rows = damaged(conversations)
    else:
        rows = conversations.select(filled("conv_id").alias("name"), F.col("turn").cast("long").alias("turn"), filled("role").alias("role"), filled("text").alias("text"))
    rows = lettered(rows, scratch)
    signed = scratch.save(signatures(rows))
    audited = scratch.save(signed.join(audits(signed), "signature").drop("signature"))
    digests = repaired(rows, audited).mapInArrow(_hash, "name string, repaired_sha256 string")
    turns = rows.where("turn is not null").groupBy("name", "turn").agg(F.lit(1).alias("one"))
    gaps = turns.groupBy("name").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    known = conversations.select("conv_id", filled("conv_id").alias("name")).distinct()
    found = known.join(audited, "name", "left").join(gaps, "name", "left").join(digests, "name", "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
