"""Byte-level BPE encoding and decoding by DuckDB's recursive queries, one engine per Python worker."""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
from collections import Counter
from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts are encoded in slices of about so many characters, so a worker's memory does not follow its partition.
SLICE_CHARS = 1_000_000
#: A longer text is encoded by so many words at a time.
SECTION_WORDS = 250_000
#: Rows that the recursion of one query may make: a word of n bytes makes at most n * n / 2 of them.
QUERY_ROWS = 1_000_000
#: Bytes of words that a worker remembers, and what each costs besides its characters. Three quarters stay, of words that most slices had.
REMEMBERED_BYTES = 48 << 20
ENTRY_BYTES = 480
#: A word takes as many steps as it has merges; beyond this many bytes a heap contracts it instead.
LONG_WORD = 400
#: Pairs of ranks are packed into one number by this base, and a rank with a place too.
BASE = 1 << 16

#: Token-position rows (word w, place p, token t, the next token n, and the rank m that both merge to)
#: of the last step make the next one: each word's pair of least rank, the leftmost of equal ones,
#: becomes one token, at its second row, which knows what follows. Only the two rows with a new pair
#: look it up among the merges. The rows of a word without pairs come once more as its last; these
#: are sorted by their places and aggregated in that order, by one thread. An ORDER BY in the aggregates
#: themselves costs half as much again; instead each word's bytes are held against the word itself.
ENCODE = f"""
with recursive r(w, p, t, n, m, last) as (
    select w, p, t, n, merges.m, false from start_rows left join merges on k = t::bigint * {BASE} + n
    union all
    (with best as (
        select w, min(m::bigint * {BASE} + p) as s from r where not last and m is not null group by w
     ), contracted as (
        select w, p, s % {BASE} as spot, s // {BASE} as made, t, n, m from r left join best using (w)
        where not last and p is distinct from s % {BASE}
     ), moved as (
        select w, case when p > spot then p - 1 else p end as p, case when p = spot + 1 then made else t end as t,
               case when p = spot - 1 then made else n end as n, m, made, p = spot - 1 or p = spot + 1 as new_pair from contracted
     )
     select w, p::int, moved.t::int, moved.n::int, case when new_pair then merges.m else moved.m end, made is null
     from moved left join merges on k = case when new_pair then moved.t::bigint * {BASE} + moved.n end)
)
select w, string_agg(d, ',') as ids, string_agg(h, '') as decoded
from (select w, d, h from r join tokens using (t) where last order by w, p) group by w order by w
"""


class Contractor:
    """A vocabulary and a DuckDB engine that encodes words with it and decodes the ids.

    The vocabulary must have all 256 bytes and ranks below 65,536, else a ``ValueError`` says so. Words are
    the matches of ``pattern`` in a whole text, whatever the pattern; characters outside all matches are lost,
    as in any encoder of this kind.
    """

    def __init__(self, path: str, pattern: str, remembered_bytes: int = REMEMBERED_BYTES):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError(f"{path} lacks single bytes")
        if not 0 <= min(self.ranks.values()) <= max(self.ranks.values()) < BASE:
            raise ValueError(f"{path} has ranks beyond {BASE - 1}")
        self.pattern = regex.compile(pattern)
        self.token = {v: k for k, v in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        #: Of each word remembered: its ids (decimal, joined by commas), the bytes they decode to, how many slices had it.
        self.ids: dict[str, str] = {}
        self.raw: dict[str, bytes] = {}
        self.used: Counter[str] = Counter()
        self.bytes, self.most = 0, remembered_bytes
        merges = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    merges[left * BASE + right] = rank
        self.tables = {
            "merges": {"k": pa.array(list(merges), pa.int64()), "m": pa.array(list(merges.values()), pa.int32())},
            "tokens": {"t": pa.array(list(self.token), pa.int32()), "d": pa.array(map(str, self.token)), "h": pa.array([k.hex() for k in self.token.values()])},
        }
        self.con = None

    def __enter__(self) -> "Contractor":
        """Start the engine: one thread, as Spark has a worker for each core; it never writes to a folder of its own."""
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        for name, columns in self.tables.items():
            self._table(name, **columns)
        return self

    def __exit__(self, *_) -> None:
        """Stop the engine and forget all words: a worker that Spark keeps for other stages holds only the vocabulary."""
        self.con.close()
        self.con = None
        for memory in (self.ids, self.raw, self.used):
            memory.clear()
        self.bytes = 0

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"create or replace table {name} as select * from given")
        self.con.unregister("given")

    def contract(self, part: list[bytes]) -> tuple[list[str], list[bytes]]:
        """Ids and decoded bytes of words, by the recursive query."""
        sizes = np.array([len(raw) for raw in part])
        ends = np.cumsum(sizes)
        tokens = self.single[np.frombuffer(b"".join(part), dtype=np.uint8)]
        after = np.append(tokens[1:], np.int32(-1))
        after[ends - 1] = -1
        self._table(
            "start_rows",
            w=pa.array(np.repeat(np.arange(len(part), dtype=np.int32), sizes)),
            p=pa.array((np.arange(len(tokens)) - np.repeat(ends - sizes, sizes)).astype(np.int32)),
            t=pa.array(tokens),
            n=pa.array(after),
        )
        found = self.con.sql(ENCODE).to_arrow_table()
        # All digits of a slice become bytes at once, which are cut where a word's digits end.
        digits = found.column("decoded").to_numpy().tolist()
        whole = bytes.fromhex("".join(digits))
        ends = list(itertools.accumulate(map(len, digits), initial=0))
        return found.column("ids").to_numpy().tolist(), [whole[a // 2 : b // 2] for a, b in zip(ends, ends[1:])]

    def contract_long(self, raw: bytes) -> tuple[str, bytes]:
        """The same contraction for one very long word, with a heap of pairs in place of a scan a step."""
        n = len(raw)
        part = [raw[i : i + 1] for i in range(n)]
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        alive = [True] * n
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) >= 0 and (rank := self.ranks.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (rank, i, len(part[i]), len(part[j])))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if not alive[i] or len(part[i]) != a or (j := after[i]) < 0 or len(part[j]) != b:
                continue
            part[i] += part[j]
            alive[j] = False
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        ids = [self.ranks[part[i]] for i in range(n) if alive[i]]
        return ",".join(map(str, ids)), b"".join(map(self.token.__getitem__, ids))

    def learn(self, wanted: set[str]) -> None:
        """Encode and decode the words that are not remembered. A word that is one token is that token."""
        fresh = list(wanted - self.ids.keys())
        raws = [word.encode() for word in fresh]
        ranks = list(map(self.ranks.get, raws))
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        whole = np.fromiter((rank is not None for rank in ranks), bool, len(ranks))
        for k in np.flatnonzero(whole).tolist():
            self.ids[fresh[k]], self.raw[fresh[k]] = str(ranks[k]), self.token[ranks[k]]
        for k in np.flatnonzero(~whole & (sizes > LONG_WORD)).tolist():
            self.ids[fresh[k]], self.raw[fresh[k]] = self.contract_long(raws[k])
        rest = np.flatnonzero(~whole & (sizes <= LONG_WORD))
        rest = rest[np.argsort(sizes[rest], kind="stable")]  # words of like length end together
        at = 0
        for end, _ in _chunks((sizes[rest] ** 2 // 2).tolist(), QUERY_ROWS):
            words, part = [fresh[k] for k in rest[at:end].tolist()], [raws[k] for k in rest[at:end].tolist()]
            ids, decoded = self.contract(part)
            if decoded != part:
                raise RuntimeError(f"words do not decode to themselves: {[w for w, x, y in itertools.zip_longest(words, decoded, part) if x != y][:5]!r}")
            self.ids.update(zip(words, ids))
            self.raw.update(zip(words, decoded))
            at = end
        self.bytes += ENTRY_BYTES * len(fresh) + 4 * sum(map(len, fresh))
        self.used.update(wanted)

    def forget(self) -> None:
        """Once memory is full, drop words that the fewest slices had, of these the oldest first, until three quarters are left."""
        if self.bytes <= self.most:
            return
        words = list(self.used)
        order = np.argsort(np.fromiter(self.used.values(), np.int64, len(words)), kind="stable")
        left = self.bytes - np.cumsum(ENTRY_BYTES + 4 * np.fromiter(map(len, words), np.int64, len(words))[order])
        n = 1 + int(np.argmax(left <= self.most * 3 // 4))
        for k in order[:n].tolist():
            for memory in (self.used, self.ids, self.raw):
                memory.pop(words[k])
        self.bytes = int(left[n - 1])

    def encode(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids, joined by commas, and the bytes they decode to, of each text."""
        cut = [self.pattern.findall(t) for t in texts]
        self.learn(set().union(*cut))
        for words in cut:
            yield ",".join(map(self.ids.__getitem__, words)), b"".join(map(self.raw.__getitem__, words))
        self.forget()

    def encode_one(self, text: str) -> tuple[str, bytes]:
        """As :meth:`encode`, for a text too long to hold all its words at a time."""
        found, ids, raw = self.pattern.finditer(text), [], []
        while words := [m.group() for m in itertools.islice(found, SECTION_WORDS)]:
            self.learn(set(words))
            ids.append(",".join(map(self.ids.__getitem__, words)))
            raw.append(b"".join(map(self.raw.__getitem__, words)))
            self.forget()
        return ",".join(ids), b"".join(raw)

    def encode_all(self, texts: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """As :meth:`encode`, in slices, whatever the texts' number and length."""
        part: list[str] = []
        size = 0
        for text in texts:
            if part and size + len(text) > SLICE_CHARS:
                yield from self.encode(part)
                part, size = [], 0
            if len(text) > SLICE_CHARS:
                yield self.encode_one(text)
            else:
                part.append(text)
                size += len(text)
        yield from self.encode(part)


def _chunks(costs: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ends of runs of about ``most`` in all, each with its sum; the last ends at the end."""
    total = 0
    for k, cost in enumerate(costs):
        total += cost
        if total >= most or k == len(costs) - 1:
            yield k + 1, total
            total = 0


@functools.lru_cache(maxsize=1)
def contractor(path: str, pattern: str) -> Contractor:
    """One vocabulary per Python worker, kept from task to task; its engine lives as long as a task."""
    return Contractor(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256, exact)`` of every row, from the whole text.

    ``ids_sha256`` is over the ids in decimal, joined by commas; ``exact`` says that decoding gave the
    text back. A null text is the empty one: no tokens, digests of nothing. There are no special
    tokens. Rows stand for themselves: a repeated row gives its result again, null ids stay null, other
    columns (whatever their names) are ignored, an empty table gives none. A text of any length is encoded
    whole, by sections. ``path`` names a rank file that each executor has (a public vocabulary is installed
    with its package). Nothing is shuffled.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with contractor(path, pattern) as engine:
            for batch in batches:
                texts = [t or "" for t in batch.column(1).to_pylist()]
                out = []
                for text, (ids, raw) in zip(texts, engine.encode_all(texts)):
                    out.append((ids.count(",") + bool(ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw).hexdigest(), raw == text.encode()))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_())
                cols = zip(*out) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"]
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean")
