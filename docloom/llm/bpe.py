"""Byte-level BPE as recursive queries.

Each partition runs an in-process DuckDB. The distinct words of a block of texts (matches of the tokenizer's
pattern) become rows of (part, position, token), one a byte. A recursive query joins neighbouring rows with
the merge table and contracts, in each part of a word, the leftmost pair of minimum rank, until no pair can
be merged. An ordered aggregation joins the token bytes of a text's ids back into text.

Three facts make words of any length cheap, and change no id:

* A token is a vocabulary entry that stands in the word, so where two neighbouring bytes stand together in
  no entry, no token ever spans them. Words are cut there into parts that are contracted apart. What is left
  of a part after some rounds is cut again, where two neighbouring tokens, joined, stand in no entry.
* After the leftmost pair of minimum rank is contracted, the next pair of that rank is the minimum again,
  as long as the new token starts or ends no pair of lower rank. One round therefore contracts all places
  of a part's minimum rank, from the left and without overlap; where the new token has a pair of lower rank
  (``alone``), it contracts the leftmost place only.
* A pair whose rank is lower than that of every entry that spans the place before it or the place after it will
  not be touched from outside before it is contracted, whatever happens around it. Such pairs are minima of a part
  of their own, and are contracted in the same round.

A part of more bytes than a query may have (a line of a million dashes) goes through the same rounds by windows of its
places, one query a window: the lowest rank is the least of all windows, and whether the last place of a window was
contracted is handed to the next one. What is left is cut as other parts are, until it fits a query or is finished.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import ship_package, trim

#: Characters of text handled at once. Words (and their bytes, with those of their ids) kept during a task.
BLOCK, KEPT_WORDS, KEPT_BYTES = 1 << 20, 450_000, 24 << 20
#: Bytes contracted by one query (at least one part), rounds of a query, and rows that its rounds may make.
ROWS, ROUNDS, MADE = 200_000, 32, 12_000_000
#: More than any rank, doubled.
NONE = 1 << 30

#: One query: `tokens` (part, pos, tok, next_tok, bar), next_tok = -1 at a part's end. `merges` has the rank of a pair,
#: doubled, plus 1 where it is `alone`; `bar` is the least rank of an entry that spans the place before a token, doubled.
#: `state` counts rounds; -1 is the fixpoint. Places of a minimum that follow each other share a token: of such a
#: chain the odd ones are contracted.
_CONTRACT = """
WITH RECURSIVE t AS (
  SELECT part, pos, tok, next_tok, bar, 0 AS state FROM tokens
  UNION ALL
  (WITH ranked AS (SELECT t.*, m.rank FROM t LEFT JOIN merges m ON m.pair = ((tok::BIGINT << 20) | next_tok) WHERE state BETWEEN 0 AND {rounds} - 1),
        lowest AS (SELECT part, min(rank) AS low, min((rank::BIGINT << 40) | pos) & ((1::BIGINT << 40) - 1) AS first FROM ranked GROUP BY part),
        near AS (SELECT *, row_number() OVER w AS n, lead(next_tok) OVER w AS after_next, lag(rank) OVER w AS r_, lag(bar) OVER w AS b_, lag(pos) OVER w AS p_, lead(rank) OVER w AS r1, lead(rank, 2) OVER w AS r2, lead(pos) OVER w AS p1, lead(pos, 2) OVER w AS p2,
                        coalesce(lead(bar) OVER w, {none}) AS b1, coalesce(lead(bar, 2) OVER w, {none}) AS b2, coalesce(lead(bar, 3) OVER w, {none}) AS b3, coalesce(lead(bar, 4) OVER w, {none}) AS b4
                 FROM ranked WINDOW w AS (ORDER BY pos)),
        placed AS (SELECT n.*, low, low & 1 = 0 AS every,
                          coalesce((rank = low AND (every OR pos = first)) OR (rank < bar AND rank < b2), false) AS hit,
                          coalesce((r_ = low AND (every OR p_ = first)) OR (r_ < b_ AND r_ < b1), false) AS hit_before,
                          coalesce((r1 = low AND (every OR p1 = first)) OR (r1 < b1 AND r1 < b3), false) AS hit_after,
                          coalesce((r2 = low AND (every OR p2 = first)) OR (r2 < b2 AND r2 < b4), false) AS hit_second
                   FROM near n JOIN lowest l ON n.part = l.part),
        chained AS (SELECT n, n - row_number() OVER (ORDER BY n) AS chain FROM placed WHERE hit AND (hit_before OR hit_after)),
        odd AS (SELECT n, row_number() OVER (PARTITION BY chain ORDER BY n) % 2 AS odd FROM chained),
        runs AS (SELECT p.*, hit AND coalesce(o.odd = 1, true) AS here, hit_before AND coalesce(b.odd = 1, true) AS gone FROM placed p LEFT JOIN odd o ON o.n = p.n LEFT JOIN odd b ON b.n = p.n - 1)
   SELECT part, pos, CASE WHEN here THEN rank >> 1 ELSE tok END,
          CASE WHEN hit THEN (CASE WHEN hit_second AND after_next <> -1 THEN r2 >> 1 ELSE after_next END) WHEN hit_after AND next_tok <> -1 THEN r1 >> 1 ELSE next_tok END,
          bar, CASE WHEN low IS NULL THEN -1 ELSE state + 1 END
   FROM runs WHERE NOT gone)
)
SELECT part, pos, tok, next_tok, bar, state FROM t WHERE state = -1 OR state = {rounds}
"""

#: A window of a long part: `tokens` (pos, tok, next_tok, bar), pos numbered through the part, with two places after
#: the window. First the lowest rank and its first place; then the places to contract, every other one of a chain;
#: `taken` is 1 if the place before the window is contracted, whose chain a chain from the window's first place continues.
_LOWEST = """
SELECT min(rank), min((rank::BIGINT << 40) | pos) & ((1::BIGINT << 40) - 1)
FROM tokens JOIN merges m ON m.pair = ((tok::BIGINT << 20) | next_tok) WHERE pos < {stop}
"""
_PLACES = """
WITH near AS (SELECT pos, rank, bar, coalesce(lead(bar, 2) OVER (ORDER BY pos), {none}) AS b2
              FROM tokens LEFT JOIN merges m ON m.pair = ((tok::BIGINT << 20) | next_tok)),
     hits AS (SELECT pos, rank FROM near WHERE pos < {stop} AND ((rank = {low} AND ({every} OR pos = {first})) OR (rank < bar AND rank < b2))),
     chained AS (SELECT *, pos - row_number() OVER (ORDER BY pos) AS chain FROM hits),
     numbered AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY pos) AS n, min(pos) OVER (PARTITION BY chain) AS opens FROM chained)
SELECT pos, rank >> 1 AS tok FROM numbered WHERE (n + CASE WHEN opens = {start} THEN {taken} ELSE 0 END) % 2 = 1
"""

_DECODE = "SELECT text, string_agg(piece, '' ORDER BY pos) FROM encoded JOIN pieces USING (tok) GROUP BY text"


def read_ranks(path: str) -> bytes:
    """The rank file, compressed, to travel with the tasks (a vocabulary, not data, bounds its size)."""
    with open(path, "rb") as f:
        return zlib.compress(f.read(), 9)


class Encoder:
    """The recursive queries over one vocabulary, and the words that a task has contracted."""

    def __init__(self, packed: bytes, pattern: str):
        import duckdb

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, zlib.decompress(packed).splitlines()) if a}
        pairs, made = [], []
        for t, rank in ranks.items():
            for i in range(1, len(t)):
                left, right = ranks.get(t[:i]), ranks.get(t[i:])
                if left is not None and right is not None:
                    pairs.append(left << 20 | right)
                    made.append(rank)
        pair, rank = np.array(pairs, dtype=np.int64), np.array(made, dtype=np.int64)
        low = np.full(max(ranks.values(), default=0) + 1, np.iinfo(np.int64).max)  # least rank of a pair with the token
        np.minimum.at(low, pair >> 20, rank)
        np.minimum.at(low, pair & 0xFFFFF, rank)
        self.find = regex.compile(pattern).findall
        self.entries, self.inside = list(ranks), None
        self.sizes = np.zeros(len(low), dtype=np.int64)
        self.sizes[list(ranks.values())] = [len(t) for t in ranks]
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        # of two bytes: the least rank of an entry in which they stand together, doubled; NONE where there is none
        self.spanned = np.full(1 << 16, NONE, dtype=np.int32)
        whole = np.frombuffer(b"".join(ranks), dtype=np.uint8).astype(np.int32)
        lengths = np.array([len(t) for t in ranks])
        inside = np.ones(len(whole), dtype=bool)
        inside[np.cumsum(lengths) - 1] = False
        made_of = np.repeat(2 * np.array(list(ranks.values()), dtype=np.int32), lengths)[:-1][inside[:-1]]
        np.minimum.at(self.spanned, (whole[:-1] << 8 | whole[1:])[inside[:-1]], made_of)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        self._table("merges", {"pair": pa.array(pair), "rank": pa.array((rank * 2 + (low[rank] < rank)).astype(np.int32))})
        self._table("pieces", {"tok": pa.array(list(ranks.values()), pa.int32()), "piece": pa.array([t.decode("latin-1") for t in ranks])})
        self.ids: dict[str, str] = {}
        self.kept = 0  # bytes of the words in ids

    def close(self) -> None:
        self.db.close()
        self.ids = {}

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("arrow_in", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM arrow_in")
        self.db.unregister("arrow_in")

    def learn(self, words: list[str]) -> None:
        """Contract words that are not known yet."""
        if not words:
            return
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        pos, tok = self._contracted(data, starts[:-1])
        names = list(map(str, tok.tolist()))
        at = np.searchsorted(pos, starts).tolist()
        for word, a, b in zip(words, at[:-1], at[1:], strict=True):
            self.ids[word] = " ".join(names[a:b])
        self.kept += len(data) + sum(map(len, names)) + len(names)

    def _contracted(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and ids of the tokens of words that lie in ``data`` from ``starts`` on."""
        edge = np.ones(len(data) + 1, dtype=bool)
        spanned = self.spanned[data[:-1].astype(np.int32) << 8 | data[1:]]
        edge[1:-1] = spanned == NONE
        edge[starts] = True
        bar = np.where(edge[:-1], NONE, np.concatenate([[NONE], spanned])).astype(np.int32)
        begin = np.flatnonzero(edge)
        tok = self.bytes[data]
        after = np.where(edge[1:], np.int32(-1), np.append(tok[1:], np.int32(-1)))
        part = (np.cumsum(edge[:-1]) - 1).astype(np.int32)
        columns = {"part": part, "pos": np.arange(len(data)), "tok": tok, "next_tok": after, "bar": bar}
        done = []
        if np.diff(begin).max(initial=0) > ROWS:
            columns, begin = self._shortened(columns, begin, data, done)
        at, rows_in, left = 0, len(columns["pos"]), {k: v[:0] for k, v in columns.items()}
        while at < rows_in or len(left["pos"]):
            room = ROWS - len(left["pos"])
            stop = at
            if at < rows_in and room > 0:  # at least one part, and what follows within the bound
                k = int(np.searchsorted(begin, at + room, side="right")) - 1
                stop = int(max(begin[k], begin[int(np.searchsorted(begin, at, side="right"))] if not len(left["pos"]) else at))
            rows = {k: np.concatenate([left[k], v[at:stop]]) for k, v in columns.items()}
            at = stop
            self._table("tokens", {k: pa.array(v) for k, v in rows.items()})
            rounds = int(np.clip(MADE // len(rows["pos"]), 2, ROUNDS))
            out = self.db.execute(_CONTRACT.format(rounds=rounds, none=NONE)).fetchnumpy()
            fixed = out["state"] == -1
            done.append((out["pos"][fixed], out["tok"][fixed]))
            order = np.flatnonzero(~fixed)
            order = order[np.argsort(out["pos"][order], kind="stable")]
            left = {k: np.asarray(out[k][order]) for k in columns}
            if len(left["pos"]):
                self._cut_again(left, data)
        pos, tok = (np.concatenate([np.asarray(d[i]) for d in done]) for i in (0, 1))
        order = np.argsort(pos, kind="stable")
        return pos[order], tok[order]

    def _shortened(self, columns: dict, begin: np.ndarray, data: np.ndarray, done: list) -> tuple[dict, np.ndarray]:
        """The rows with every part of at most ROWS, and where parts begin; tokens of finished parts go to ``done``."""
        sizes = np.diff(begin)
        short = np.repeat(sizes <= ROWS, sizes)
        kept = [{k: v[short] for k, v in columns.items()}]
        long = [{k: v[a:b] for k, v in columns.items()} for a, b in zip(begin[:-1], begin[1:], strict=True) if b - a > ROWS]
        while long:
            rows = self._round(long.pop())
            if rows["part"] is None:
                done.append((rows["pos"], rows["tok"]))
                continue
            self._cut_again(rows, data)
            ends = np.flatnonzero(rows["next_tok"] == -1) + 1
            small, sizes = np.ones(len(rows["pos"]), dtype=bool), np.diff(np.append(0, ends))
            for a, n in zip((ends - sizes).tolist(), sizes.tolist(), strict=True):
                if n > ROWS:
                    long.append({k: v[a : a + n].copy() for k, v in rows.items()})
                    small[a : a + n] = False
            kept.append({k: v[small] for k, v in rows.items()})
        out = {k: np.concatenate([x[k] for x in kept]) for k in columns}
        order = np.argsort(out["pos"], kind="stable")
        out = {k: v[order] for k, v in out.items()}
        opens = np.concatenate([[True], out["next_tok"][:-1] == -1]) if len(order) else np.zeros(0, dtype=bool)
        out["part"] = (np.cumsum(opens) - 1).astype(np.int32)
        return out, np.append(np.flatnonzero(opens), len(order))

    def _round(self, rows: dict) -> dict:
        """One round of a part too long for a query, window after window; ``part`` is None if it is finished."""
        tok, bar, n = rows["tok"], rows["bar"], len(rows["tok"])
        place, next_tok = np.arange(n), np.append(tok[1:], np.int32(-1))
        windows = [(a, min(a + ROWS, n)) for a in range(0, n, ROWS)]

        def ask(a: int, b: int, sql: str, **values):
            part = slice(a, min(b + 2, n))
            self._table("tokens", {"pos": pa.array(place[part]), "tok": pa.array(tok[part]), "next_tok": pa.array(next_tok[part]), "bar": pa.array(bar[part])})
            return self.db.execute(sql.format(start=a, stop=b, none=NONE, **values))

        found = [x for a, b in windows if (x := ask(a, b, _LOWEST).fetchall()[0])[0] is not None]
        if not found:
            return {**rows, "part": None}
        low = min(x for x, _ in found)
        first = min(p for x, p in found if x == low)
        taken, made = np.zeros(n, dtype=bool), tok.copy()
        for a, b in windows:
            out = ask(a, b, _PLACES, low=low, first=first, every=str(low & 1 == 0), taken=int(a > 0 and taken[a - 1])).fetchnumpy()
            taken[out["pos"]] = True
            made[out["pos"]] = out["tok"]
        keep = np.append(True, ~taken[:-1])
        tok = made[keep]
        return {"part": np.zeros(len(tok), dtype=np.int32), "pos": rows["pos"][keep], "tok": tok, "next_tok": np.append(tok[1:], np.int32(-1)), "bar": bar[keep]}

    def _cut_again(self, left: dict, data: np.ndarray) -> None:
        """Cut parts that are not finished where their tokens, joined, stand in no entry (equal hashes only hide a cut)."""
        if self.inside is None:
            self.inside = np.unique(np.fromiter((hash(t[i:j]) for t in self.entries for i in range(len(t)) for j in range(i + 2, len(t) + 1)), dtype=np.int64))
        raw, begin, size = data.tobytes(), left["pos"].tolist(), self.sizes[left["tok"]]
        ends = (left["pos"] + size).tolist()
        joined = np.flatnonzero(left["next_tok"] != -1)
        spans = np.fromiter((hash(raw[begin[k] : ends[k + 1]]) for k in joined.tolist()), dtype=np.int64, count=len(joined))
        at = np.minimum(np.searchsorted(self.inside, spans), len(self.inside) - 1)
        cut = joined[self.inside[at] != spans]
        left["next_tok"][cut] = -1
        left["bar"][cut + 1] = NONE
        ends_here = np.concatenate([[0], (left["next_tok"] == -1)[:-1]])
        left["part"] = (-1 - np.cumsum(ends_here)).astype(np.int32)  # apart from the numbers of whole parts

    def encode(self, texts: list[str]) -> list[list[str]]:
        """The words of each text, all of them learned."""
        split = [self.find(t) for t in texts]
        wanted = set().union(*split)
        new = wanted.difference(self.ids)
        if len(self.ids) + len(new) > KEPT_WORDS or self.kept > KEPT_BYTES:  # make room: keep this block's words alone
            self.ids = {w: self.ids[w] for w in wanted if w in self.ids}
            self.kept = sum(len(w) + len(i) for w, i in self.ids.items())
        self.learn(list(new))
        return split

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each array of ids, by ordered aggregation."""
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        if not sizes.sum():
            return [b""] * len(ids)
        text = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        self._table("encoded", {"text": pa.array(text), "pos": pa.array(np.arange(len(text), dtype=np.int32)), "tok": pa.array(np.concatenate(ids).astype(np.int32))})
        found = dict(self.db.execute(_DECODE).fetchall())
        return [found.get(i, "").encode("latin-1") for i in range(len(ids))]


#: What a pass over the texts can return.
OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string"}
_ARROW = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.binary(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def encode(docs: DataFrame, path: str, pattern: str, *, outputs: tuple[str, ...] = ("n_tokens", "ids"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the chosen OUTPUTS for each document, from its whole text.

    ``ids`` are the token ids (special tokens do not occur), ``decoded`` the bytes that these ids decode to;
    ``ids_sha256`` is the digest of the decimal ids joined by single spaces. A null text counts as
    empty, and an empty text has no ids. Repeated rows are encoded each; an empty table gives an empty
    result. Nothing is shuffled, and a lost task starts again from its input. A task's words, database and
    vocabulary go when it ends.
    """
    packed = read_ranks(path)
    ship_package(docs.sparkSession)
    decoding = any(name.startswith("decoded") for name in outputs)

    def coded(encoder: Encoder, part: list[str]) -> list[pa.Array]:
        joined = [" ".join(map(encoder.ids.__getitem__, words)) for words in encoder.encode(part)]
        ids = [np.fromstring(s, dtype=np.int32, sep=" ") for s in joined]
        texts = encoder.decode(ids) if decoding else []
        made = {
            "n_tokens": lambda: map(len, ids),
            "ids": lambda: ids,
            "decoded": lambda: texts,
            "ids_sha256": lambda: (hashlib.sha256(s.encode()).hexdigest() for s in joined),
            "decoded_sha256": lambda: (hashlib.sha256(t).hexdigest() for t in texts),
        }
        return [pa.array(list(made[name]()), _ARROW[name]) for name in outputs]

    def run(batches):
        encoder = Encoder(packed, pattern)
        try:
            for batch in batches:
                texts, at = batch.column("text"), 0
                while at < len(texts):
                    part, size = [], 0
                    while at + len(part) < len(texts) and (not part or size < BLOCK):
                        part.append(texts[at + len(part)].as_py())
                        size += len(part[-1])
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(part)), *coded(encoder, part)], names=["doc_id", *outputs])
                    at += len(part)
        finally:
            encoder.close()
            trim()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{name} {OUTPUTS[name]}" for name in outputs)]))


def decode(encoded: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, decoded``: the bytes of each row's token ids, by ordered aggregation; null ids count as none.

    Repeated rows are decoded each; an empty table gives an empty result.
    """
    packed = read_ranks(path)
    ship_package(encoded.sparkSession)

    def run(batches):
        encoder = Encoder(packed, pattern)
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64)
                    texts = encoder.decode([np.asarray(x or [], dtype=np.int32) for x in part.column("ids").to_pylist()])
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "decoded"])
        finally:
            encoder.close()
            trim()

    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {encoded.schema[id_col].dataType.simpleString()}, decoded binary")
