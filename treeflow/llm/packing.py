"""Mixture-controlled packing by deficit round-robin.

Each source is a queue of tokens. Windows of ``WINDOW`` sequences visit the queues in turn; a queue receives its quantum
(its target share of the window) plus the deficit it carries. Shares are rarely whole numbers of tokens, so a queue that
got less than its share in one window gets the missing token later. With one-token quanta this is the order of virtual
finish times ``(k + 1/2) / rate``: the k-th token of a queue is due when the queue's credit reaches k + 1/2. What a queue
has received before any window is therefore known without running the windows before it (``Mixture.given``), and so every
partition continues the carried deficits exactly where the one before it stopped, in parallel. A queue that runs dry
leaves its share to the others.

Two passes, no shuffle of text or ids: (1) each input partition tokenises its rows and writes the ids with their running
position in their source; (2) positions become global by prefix sums over the small table of (partition, source) totals,
and each document is cut into pieces on its own.

Defined results: null text is empty (one id: the closing 1); a null source is a queue of its own; repeated rows are packed
like any other; an empty table gives no rows. Only the last sequence is short. With ``weights``, sources that it doesn't name
have target 0 and come last.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, checked_broadcast, map_rows, materialise, to_arrow

SEQUENCE = 2048
#: Sequences a window: within each window the target proportions hold to a token.
WINDOW = 16
END_ID = 1
#: Queues up to which a heap finds the last tokens of a window; more are searched as arrays, and documents are visited by time.
HEAP_QUEUES = 256
#: Bytes of windows that a worker remembers.
WINDOW_BYTES = 64 << 20
#: Pieces that a worker remembers (about 150 bytes each), and words of pieces with marks.
CACHE_ENTRIES = 700_000
WORD_ENTRIES = 150_000
#: Bytes of text that are encoded at once.
SLICE_BYTES = 6 << 20
TOKENS = "doc_id long, source string, part int, start long, ids binary"
# Marks that never join a following letter; words that show whether the merges can be used directly.
MARKS = ".,;:!?*#$%&|-_)(\"/"
PROBES = ("a", "the", "pretokenization", "straße", "éèêç", "ñandú", "über", "ø", "qqxzj")
PROBE_TEXTS = ("Hello, World. A  b", "(Über) straße; it's 12,5 x.y", "one|two <b> #3 a_b", "Ñandú, éèêç. \"Ok\" - no!?")
TOKENIZER = "word_bpe_49k.json"


class Encoder:
    """Ids of whole texts, equal to the tokenizer's own. Where its pre-tokenizer drops white space and never joins across it
    (probed), texts are cut at spaces and line ends and the ids of each piece are kept in a bounded cache."""

    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.seen: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}
        # byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on, in order
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.bytes = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in own)}
        model = self.tokenizer.model
        self.merge = lambda w: [x.id for x in model.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(self.bytes))]
        try:  # words may go to the merges directly if that gives the tokenizer's ids
            self.direct = all(self.merge(w) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in PROBES)
        except Exception:
            self.direct = False
        #: whether the tokenizer lower-cases, drops white space and splits as this class takes for granted; others encode whole texts
        self.fits = all(b"".join(self.chunk(w) for w in t.split()) == self._plain(t) == self._plain(t.lower()) == self._plain(t.replace(", ", " , ").replace(" ", "\n")) for t in PROBE_TEXTS)

    def _plain(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, self.kind).tobytes()

    def _new_word(self, word: str) -> bytes:
        # letters below U+0250 are composed and lower already: normalising and splitting leave such a word alone
        if self.direct and max(word) < "\u0250" and word.isalpha():
            return np.array(self.merge(word), self.kind).tobytes()
        return self._plain(word)

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            found = self._new_word(word)
            if len(self.words) < WORD_ENTRIES:
                self.words[word] = found
        return found

    def chunk(self, chunk: str) -> bytes:
        """The ids of a piece without white space, by way of its word where that can't change them."""
        if "Σ" in chunk:  # lower() knows a final sigma, the tokenizer doesn't
            return self._plain(chunk)
        bare = chunk.rstrip(MARKS)
        if (word := bare.lower()).isalpha():  # letters and marks after them are split in any case
            return self._new_word(word) if bare == chunk else self._word(word) + self._word(chunk[len(bare) :])
        return self._plain(chunk)

    def _chunk(self, chunk: str) -> bytes:
        found = self.chunk(chunk)
        if len(self.seen) < CACHE_ENTRIES:
            self.seen[chunk] = found
        return found

    def __call__(self, text: str) -> bytes:
        if not self.fits:
            return self._plain(text)
        get = self.seen.get
        return b"".join([x if (x := get(w)) is not None else self._chunk(w) for w in text.replace("\n", " ").split(" ")])


class Batches:
    """Ids of many texts at once: pieces are split and numbered by Arrow, looked up once a slice, and gathered by numpy."""

    def __init__(self, name: str):
        self.one = Encoder(name)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.starts, self.lengths = bytearray(), array("q"), array("q")

    def _number(self, chunk: str) -> int:
        found = self.one.chunk(chunk) if chunk else b""
        width = self.one.kind().itemsize
        self.starts.append(len(self.ids) // width)
        self.lengths.append(len(found) // width)
        self.ids += found
        n = self.number[chunk] = len(self.number)
        return n

    def __call__(self, texts) -> Iterator[bytes]:
        """``texts``: an Arrow array of strings without nulls."""
        if not self.one.fits:
            yield from map(self.one, texts.to_pylist())
            return
        # case of ASCII letters, and full stops and commas after letters or digits, make no difference to the ids: with
        # them out of the way there are fewer different pieces. Where they could matter, texts stay as they are.
        odd = pc.match_substring_regex(texts, r"İ|<\||[^\s\pL\pN][.,](\s|$)")
        texts = pc.replace_substring(texts, "\n", " ")
        plain = pc.replace_substring(pc.replace_substring(pc.ascii_lower(texts), ", ", " , "), ". ", " . ")
        texts = pc.if_else(odd, texts, plain)
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(sizes):
            end, total = at, 0
            while end < len(sizes) and (end == at or total + sizes[end] <= SLICE_BYTES):
                total += sizes[end]
                end += 1
            if total > 4 * SLICE_BYTES:  # one very long text
                yield self.one(texts[at].as_py())
            else:
                yield from self._slice(texts.slice(at, end - at))
            at = end

    def _slice(self, texts) -> Iterator[bytes]:
        if len(self.number) > CACHE_ENTRIES:
            self.clear()
        parts = pc.split_pattern(texts, " ")
        bounds = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        get = self.number.get
        own = np.array([n if (n := get(w)) is not None else self._number(w) for w in coded.dictionary.to_pylist()], np.int32)
        starts, lengths, flat = np.array(self.starts, np.int32), np.array(self.lengths, np.int32), np.frombuffer(bytes(self.ids), self.one.kind)
        chunk = own[coded.indices.to_numpy()]
        n = lengths[chunk]
        ends = np.cumsum(n)
        where = np.repeat(starts[chunk] - (ends - n).astype(np.int32), n)
        where += np.arange(len(where), dtype=np.int32)
        ids = flat[where]
        ends = np.concatenate([[0], ends])[bounds]
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            yield ids[a:b].tobytes()


class Mixture:
    """Who gets the first n tokens of the whole mixture, for any n."""

    def __init__(self, totals: list[int], weights: list[float] | None = None):
        self.totals = np.array(totals, np.int64)
        self.rates = np.array(weights if weights is not None else totals, np.float64)
        self.rates = np.where(self.rates > 0, self.rates, 1e-9 * max(1.0, self.rates.max(initial=1.0)))
        self.all = int(self.totals.sum())
        self.known: dict[int, np.ndarray] = {}

    def _time(self, n: int) -> float:
        """A virtual time at which about n tokens are out: sum(min(total, rate * v)) = n, queues running dry one by one."""
        ends = self.totals / self.rates
        order = np.argsort(ends)
        rest = np.concatenate([np.cumsum(self.rates[order][::-1])[::-1], [0.0]])
        done = np.concatenate([[0], np.cumsum(self.totals[order])])
        out = done[:-1] + rest[:-1] * ends[order]
        i = min(int(np.searchsorted(out, n)), len(ends) - 1)
        return float((n - done[i]) / rest[i])

    def given(self, n: int) -> np.ndarray:
        """Tokens of each queue among the first n: the n smallest keys (k + 1/2) / rate, ties to the earlier queue."""
        found = self.known.get(n)
        if found is None:
            if len(self.known) > min(4096, max(8, WINDOW_BYTES // (8 * len(self.totals)))):
                self.known.clear()
            found = self.known[n] = self._given(min(n, self.all))
        return found

    def _given(self, n: int) -> np.ndarray:
        if n <= 0:
            return np.zeros(len(self.totals), np.int64)
        if len(self.totals) > HEAP_QUEUES:
            return self._searched(n)
        # by then at most n tokens are due (each queue is within half a token of its credit), so all of k's are among the n
        start = max(0.0, self._time(max(0, n - len(self.totals))))
        k = np.clip(np.floor(self.rates * start - 0.5).astype(np.int64), 0, self.totals)
        heap = [((k[s] + 0.5) / self.rates[s], s) for s in range(len(k)) if k[s] < self.totals[s]]
        heapq.heapify(heap)
        for _ in range(n - int(k.sum())):
            _, s = heap[0]
            k[s] += 1
            if k[s] < self.totals[s]:
                heapq.heapreplace(heap, ((k[s] + 0.5) / self.rates[s], s))
            else:
                heapq.heappop(heap)
        return k

    def _searched(self, n: int) -> np.ndarray:
        """The same for many queues: bisection for a time by which at most n tokens are out, then the rest in key order, as
        many at once as come before the second next token of any of them."""

        def out(v: float, slack: float) -> np.ndarray:
            return np.minimum(np.floor(self.rates * (v * (1 + slack)) + 0.5), self.totals)

        low, high = 0.0, max(self._time(min(n + len(self.totals), self.all)), self._time(n)) * 1.001
        for _ in range(60):
            middle = (low + high) / 2
            if out(middle, 1e-9).sum() <= n:
                low = middle
            else:
                high = middle
            if high - low <= 1e-12 * high:
                break
        k = out(low, -1e-9).astype(np.int64)
        while left := n - int(k.sum()):
            due = np.where(k < self.totals, (k + 0.5) / self.rates, np.inf)
            order = np.argsort(due, kind="stable")[:left]
            order = order[np.isfinite(due[order])]
            after = np.minimum.accumulate((k[order] + 1.5) / self.rates[order])
            late = np.flatnonzero(due[order[1:]] >= after[:-1])
            k[order[: late[0] + 1] if late.size else order] += 1
        return k

    def due(self, s: int, j: int) -> int:
        """About how many tokens are out when queue s's j-th is: a first guess for the window."""
        v = (j + 0.5) / self.rates[s]
        return int(np.minimum(self.totals, self.rates * v).sum())


def pieces(mix: Mixture, queue: int, start: int, n: int, sequence: int, window: int):
    """``(first id, length, sequence, offset)`` of each piece of a document whose ids are start..start+n-1 of a queue."""
    span = sequence * window
    w = max(0, min(mix.due(queue, start) // span, (mix.all - 1) // span))
    while w and mix.given(w * span)[queue] > start:
        w -= 1
    at = 0
    while at < n:
        before, after = mix.given(w * span), mix.given((w + 1) * span)
        room = int(after[queue]) - (start + at)
        if room <= 0:
            w += 1
            continue
        place = w * span + int((after[:queue] - before[:queue]).sum()) + start + at - int(before[queue])
        stop = at + min(room, n - at)
        while at < stop:
            offset = place % sequence
            length = min(stop - at, sequence - offset)
            yield at, length, place // sequence, offset
            at, place = at + length, place + length


def tokenise(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``doc_id, source, part, start, ids``: ids as little-endian integers; start counts within (part, source)."""
    from pyspark import TaskContext

    rows = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")))

    arrow = to_arrow(docs.sparkSession, TOKENS)

    def run(it):
        encoder, out, part = Batches(tokenizer), {}, TaskContext.get().partitionId()
        end, width = np.array([END_ID], encoder.one.kind).tobytes(), encoder.one.kind().itemsize

        def rows():
            for batch in it:
                for doc, source, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), encoder(batch.column(1))):
                    ids += end
                    start = out.get(source, 0)
                    out[source] = start + len(ids) // width
                    yield doc, source, part, start, ids

        return batches(rows(), arrow, 512)

    return rows.mapInArrow(run, TOKENS)


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, weights: Mapping[str, float] | None = None, sequence: int = SEQUENCE, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Pack all documents. ``weights``: target proportions by source (default: each source's share of all tokens, so that
    every window has the corpus's mixture and all queues end together).

    Gives ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and the piece's ``source``.
    """
    width = Encoder(tokenizer).kind().itemsize
    tokens = materialise(tokenise(docs, tokenizer, id_col, text_col, source_col), "pack-ids")
    spark = tokens.sparkSession
    totals = materialise(tokens.groupBy("source", "part").agg(F.sum(F.octet_length("ids") / width).cast("long").alias("n")), "pack-totals")
    sources = totals.groupBy("source").agg(F.sum("n").alias("n"))
    sources = sources.withColumn("queue", F.row_number().over(Window.orderBy(F.desc("n"), "source")) - 1)
    sources = materialise(sources, "pack-sources")  # a narrow row a source
    found = sources.orderBy("queue").toArrow()
    queues, rates = found["n"].to_numpy(), None
    if weights is not None:
        rates = np.array([float(weights.get(s[1:], 0.0)) for s in found["source"].to_pylist()])
    by_part = totals.join(checked_broadcast(sources.select("source", "queue")), "source")
    base = by_part.select("source", "part", "queue", (F.sum("n").over(Window.partitionBy("queue").orderBy("part")) - F.col("n")).alias("base"))
    placed = tokens.join(checked_broadcast(materialise(base, "pack-base")), ["source", "part"]).select("doc_id", "source", "queue", (F.col("base") + F.col("start")).alias("first"), "ids")

    if len(queues) > HEAP_QUEUES:  # a task's documents by the time they are due, so that it meets its windows in turn
        speed = sources.select("queue", "n") if rates is None else spark.createDataFrame([(i, float(r)) for i, r in enumerate(rates)], "queue int, n double")
        placed = placed.join(checked_broadcast(speed), "queue").sortWithinPartitions((F.col("first") + 0.5) / F.greatest("n", F.lit(1e-9)))
        placed = placed.select("doc_id", "source", "queue", "first", "ids")

    def make():
        mix = Mixture(queues, rates)
        kind = "<u2" if width == 2 else "<u4"

        def each(row):
            doc, source, q, first, raw = row
            n = len(raw) // width
            ids = np.frombuffer(raw, kind).astype("<u4").tobytes()
            for at, length, seq, offset in pieces(mix, q, first, n, sequence, window):
                yield doc, at, length, zlib.crc32(memoryview(ids)[4 * at : 4 * (at + length)]), n, seq, offset, source[1:] if source else None

        return each

    return map_rows(placed, make, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")
