"""SentencePiece encoding of merge-type models by backtracking, and decoding.

A token sequence is the merge encoding of its text exactly if every two neighbours, merged anew from their
characters, come apart into the same two tokens, and the text of a prefix has one such sequence. So the
encoder walks through a text with the longest piece at each position (all pieces at all positions come
from one Aho-Corasick pass), takes a shorter one when the pair check fails, and goes back a token when
none is left, marking the position in a bit field as one that no token ends at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
_BLOCK = 1 << 10
_NEVER = float("-inf")
_CACHE, _CACHE_CHARS, _PAIRS = 1 << 18, 48, 1 << 19


#: A match: the piece's length, its id, and the match of the longest shorter piece that it starts with.
Match = tuple[int, int, "Match | None"]


class _Longest:
    """The longest piece at each position of a long run, computed by blocks; a few are held."""

    def __init__(self, of, length: int):
        self.of, self.length, self.blocks = of, length, {}

    def __getitem__(self, pos: int) -> Match:
        b = pos // _BLOCK
        if b not in self.blocks:
            if len(self.blocks) >= 64:
                self.blocks.clear()
            self.blocks[b] = self.of(b * _BLOCK, min(self.length, (b + 1) * _BLOCK))
        return self.blocks[b][pos % _BLOCK]


class MergeEncoder:
    """Encodes texts as the library does for a model of merge type with byte fallback.

    Pieces hold the space sign at their start only, so that no merge crosses the start of a run of space
    signs: the runs with what follows them are encoded one by one and kept in a bounded cache.
    """

    def __init__(self, model: bytes):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(sp.get_piece_size())
        self.bytes = {int(sp.id_to_piece(i)[1:-1], 16): i for i in ids if sp.is_byte(i)}
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in ids
                      if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        self.text = [sp.id_to_piece(i) for i in ids]
        if any(map(sp.is_unused, ids)) or len(self.bytes) != 256:
            raise ValueError("the model must have byte fallback and no unused pieces")
        if any(SPACE in p.lstrip(SPACE) or any(c not in self.score for c in p) for p in self.score):
            raise ValueError("pieces must start with their space signs and be made of single-character pieces")
        self.longest = max(map(len, self.score))
        self.known = frozenset(p for p in self.score if len(p) == 1)
        self.automaton = ahocorasick.Automaton()
        made: dict[str, Match] = {}
        for p in sorted(self.score, key=len):
            if len(self.merge(p)) == 1:  # a piece that merging cannot make is never a token
                shorter = next((made[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in made), None)
                made[p] = (len(p), sp.piece_to_id(p), shorter)
                self.automaton.add_word(p, made[p])
        self.automaton.make_automaton()
        self.end = sp.eos_id()
        self.pairs: dict[int, bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        plain = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) for i in ids]
        self.spelled = [b"" if x else t.replace(SPACE, " ").encode() for x, t in zip(plain, self.text, strict=True)]
        for value, i in self.bytes.items():
            self.spelled[i] = bytes([value])

    def merge(self, text: str) -> list[str]:
        """Merging from single characters: the best score first, of equal ones the leftmost."""
        parts, of = list(text), self.score.get
        scores = [of(a + b, _NEVER) for a, b in zip(text, text[1:], strict=False)]
        while scores and (best := max(scores)) > _NEVER:
            i = scores.index(best)
            parts[i] += parts.pop(i + 1)
            scores.pop(i)
            if i:
                scores[i - 1] = of(parts[i - 1] + parts[i], _NEVER)
            if i < len(scores):
                scores[i] = of(parts[i] + parts[i + 1], _NEVER)
        return parts

    def joinable(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their joint text is merged anew."""
        if len(self.pairs) >= _PAIRS:
            self.pairs.clear()
        a, b = self.text[left], self.text[right]
        found = self.pairs[left << 32 | right] = self.merge(a + b) == [a, b]
        return found

    def _block(self, run: str, start: int, stop: int) -> list[Match]:
        found: list = [None] * (stop - start)
        for end, match in self.automaton.iter(run, start, min(len(run), stop + self.longest)):
            at = end + 1 - match[0] - start
            if at < stop - start:
                found[at] = match
        return found

    def encode_known(self, run: str) -> list[int]:
        """The tokens of a text whose characters are all pieces."""
        n = len(run)
        if n > _BLOCK:
            longest = _Longest(lambda a, b: self._block(run, a, b), n)
        else:
            longest = [None] * n
            for end, match in self.automaton.iter(run):  # a longer piece comes later
                longest[end + 1 - match[0]] = match
        pairs, joinable, text = self.pairs.get, self.joinable, self.text
        failed, clean = bytearray(n // 8 + 1), True
        tokens: list[int] = []
        pos, last, here = 0, -1, longest[0]
        while pos < n:
            while here is not None:
                size, token, shorter = here
                end = pos + size
                if clean or not failed[end >> 3] >> (end & 7) & 1:
                    if last < 0:
                        break
                    fits = pairs(last << 32 | token)
                    if fits or fits is None and joinable(last, token):
                        break
                here = shorter
            if here is None:
                failed[pos >> 3] |= 1 << (pos & 7)
                clean = False
                token = tokens.pop()
                pos -= len(text[token])
                last = tokens[-1] if tokens else -1
                here = longest[pos]
                while here[1] != token:
                    here = here[2]
                here = here[2]
            else:
                tokens.append(token)
                pos, last = end, token
                if pos < n:
                    here = longest[pos]
        return tokens

    def encode_run(self, run: str) -> tuple[int, ...]:
        """The tokens of a run; characters that no piece has become bytes."""
        found = self.older.get(run)
        if found is not None:
            return self._keep(run, found)
        if self.known.issuperset(run):
            return self._keep(run, tuple(self.encode_known(run)))
        out: list[int] = []
        start = 0
        for i, c in enumerate(run):
            if c not in self.known:
                if start < i:
                    out += self.encode_known(run[start:i])
                out += [self.bytes[b] for b in c.encode()]
                start = i + 1
        if start < len(run):
            out += self.encode_known(run[start:])
        return self._keep(run, tuple(out))

    def _keep(self, run: str, tokens: tuple[int, ...]) -> tuple[int, ...]:
        """Remembers a short run; of two generations of runs the older one goes when the newer is full."""
        if len(run) <= _CACHE_CHARS:
            if len(self.cache) >= _CACHE:
                self.cache, self.older = {}, self.cache
            self.cache[run] = tokens
        return tokens

    def encode(self, text: str) -> list[int]:
        """All tokens of a text with the end id."""
        out: list[int] = []
        encode = self.encode_run
        signs = ""
        for i, part in enumerate(self.library.normalize(text).split(SPACE)):
            if i:
                signs += SPACE
            if part:
                run = signs + part
                out += self.cache.get(run) or encode(run)
                signs = ""
        if signs:
            out += encode(signs)
        out.append(self.end)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of the ids as the library decodes them; invalid bytes are left to the library."""
        try:
            return b"".join(map(self.spelled.__getitem__, ids)).decode().removeprefix(" ")
        except UnicodeDecodeError:
            return self.library.decode(ids)


@lru_cache(maxsize=1)
def kept_encoder(model: bytes) -> MergeEncoder:
    """The encoder of a worker, whose tables and bounded caches serve one task after another; Spark ends workers that are idle for a minute."""
    return MergeEncoder(model)


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids, decoded): the token ids of every whole text with an end id, and the text they decode to.

    Null and empty texts have the end id alone. Repeated rows and null keys are kept as they are, an empty
    table gives no rows, columns other than key and text are not read. The model file (under one
    megabyte) is read on the driver and sent to the workers; memory is bounded by the longest text.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = pa.schema([("key", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = kept_encoder(model.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = [enc.encode(t.as_py() or "") for t in part.column(1)]
                yield pa.record_batch([
                    part.column(0), pa.array(ids, schema.field("ids").type), pa.array(map(enc.decode, ids), pa.string()),
                ], schema=schema)

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string")).mapInArrow(
        run, "key long, ids array<int>, decoded string")


def op9_sentencepiece(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode_decode(docs, model_path).select(
        F.col("key").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
