"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding as a state machine.

Lookahead. Rules are applied by rank, leftmost first, and a rule ranks after those that make its two parts (checked on
loading). Compare a text with a continuation of it: at first both have the same symbols up to the text's end. A rule (u, v)
moves the first difference to the left only where the last common token is u and what follows it is v in one of the two
only; it then moves by |u|. The next rule (u', v') that moves it further meets there a token that begins with u, so u is v' or
on its left spine (its left part, the left part of that, ...). The sum of |u| along the dearest such chain of rules of
rising rank is therefore how far back a continuation can reach: `lookahead`. Tokens that end that many bytes before the end
of what has been read are stable. The transducer reads blocks, emits the stable tokens and keeps the rest, at most
`lookahead` bytes and the longest token, so its memory doesn't grow with the text, also in a run of letters without end.
A piece's last byte is another symbol where the list has a suffix for word ends, so one more byte is held back.

Pieces. Special tokens are cut out of the raw text; what is between them is brought to NFC, lower-cased letter by letter and cut
into contractions, runs of letters, single digits and runs of other signs; white space separates. Texts are read in chunks that
end where neither composition nor a piece can go on, or else, in a run, with the run left open. Pieces of at most MEMO_CHARS are
remembered, at most MEMO of them in a worker.

Decoding reads ids one block after the other: `tokens` joins the tokens' own spelling by spaces, which is what the file's missing
decoder means; `text` undoes the byte alphabet and keeps unfinished UTF-8 sequences until their last byte has come.

A null text is empty: no tokens. Rows that repeat are rows of their own, null ids are kept, other columns don't matter; an empty
table gives an empty one. A vocabulary file is a parameter; it is read on the driver, held to MAX_FILE bytes and sent to workers.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_FILE = 24 << 20
CHUNK = 1 << 16
MEMO = 1 << 17
MEMO_CHARS = 64
FEW = 64

#: Fixed value: the pieces that this kind of vocabulary file is made for.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECES = regex.compile(PIECES)
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)  # the same, of lower-cased ASCII
_GOES_ON = {"letters": regex.compile(r"\p{L}*"), "signs": regex.compile(r"[^\s\p{L}\p{N}]*")}
_LETTER, _DIGIT = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")


def byte_alphabet() -> list[str]:
    """The sign that stands for each byte: printable ones for themselves, the others for 256 and up in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """A merge list with its vocabulary: what the transducer looks up."""

    def __init__(self, file: str):
        d = json.loads(file)
        model, steps = d["model"], d["normalizer"]["normalizers"]
        split, *byte_level = d["pre_tokenizer"]["pretokenizers"]
        as_known = (
            model["type"] == "BPE" and not model.get("dropout") and not model.get("unk_token") and not model.get("continuing_subword_prefix") and not model.get("ignore_merges")
            and [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
            and split["pattern"] == {"Regex": PIECES} and split["behavior"] == "Removed" and split["invert"]
            and [(b["type"], b["add_prefix_space"], b["use_regex"]) for b in byte_level] == [("ByteLevel", False, False)] and d["decoder"] is None
            and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in d["added_tokens"])
        )
        if not as_known:
            raise ValueError("this vocabulary file asks for steps that the transducer does not take")
        self.file, vocab, end = file, model["vocab"], model.get("end_of_word_suffix") or ""
        self.suffix = end
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.names = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for name, i in (vocab | self.special).items():
            self.names[i] = name
        alphabet = byte_alphabet()
        self.inner, self.last = [vocab[c] for c in alphabet], [vocab[c + end] for c in alphabet]
        self.size = [0] * len(self.names)
        made: dict[int, int | None] = dict.fromkeys([*self.inner, *self.last])  # a token's left part
        for i in made:
            self.size[i] = 1
        self.rank, self.product, reach, back = {}, [], {}, 0
        for rank, rule in enumerate(model["merges"]):
            u, v = rule if isinstance(rule, list) else rule.split(" ")
            a, b, ab = vocab[u], vocab[v], vocab[u + v]
            if a not in made or b not in made or ab in made:
                raise ValueError(f"rule {rank} does not come after the rules that make its parts, or makes a token again")
            self.rank[a, b] = rank
            self.product.append(ab)
            self.size[ab], so_far, t = self.size[a] + self.size[b], 0, b
            while t is not None:  # the left spine of v
                so_far, t = max(so_far, reach.get(t, 0)), made[t]
            made[ab] = a
            reach[a] = max(reach.get(a, 0), so_far + self.size[a])
            back = max(back, reach[a])
        self.lookahead = back

    def merge(self, symbols: list[int]) -> list[int]:
        """The tokens of a sequence of symbols: the best ranked pair first, the leftmost of equals."""
        return self._merge_few(symbols) if len(symbols) <= FEW else self._merge_many(symbols)

    def _merge_few(self, symbols: list[int]) -> list[int]:
        ids, rank_of, product, none = list(symbols), self.rank.get, self.product, len(self.product)
        ranks = [rank_of(p, none) for p in zip(ids, ids[1:])]
        while ranks and (r := min(ranks)) < none:
            i = ranks.index(r)
            ids[i : i + 2] = [product[r]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = rank_of((ids[i], ids[i + 1]), none)
        return ids

    def _merge_many(self, symbols: list[int]) -> list[int]:
        ids, n, rank_of = list(symbols), len(symbols), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, p in enumerate(zip(ids, ids[1:])) if (r := rank_of(p)) is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank_of((ids[i], ids[j])) != rank:
                continue  # one of the two has been merged since
            ids[i], ids[j], k = self.product[rank], -1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (r := rank_of((ids[i], ids[k]))) is not None:
                    heappush(heap, (r, i))
            if (p := before[i]) >= 0 and (r := rank_of((ids[p], ids[i]))) is not None:
                heappush(heap, (r, p))
        return [x for x in ids if x >= 0]


class Transducer:
    """Takes a piece's bytes in parts and gives its tokens as soon as they are stable."""

    def __init__(self, merges: Merges, block: int = 0):
        self.m, self.block = merges, block or max(4096, 4 * merges.lookahead)
        self.kept: list[int] = []  # symbols whose tokens are not stable
        self.held = b""  # the last byte read: it may end the piece

    def push(self, part: bytes) -> list[int]:
        data = self.held + part
        self.held, inner = data[-1:], self.m.inner
        out: list[int] = []
        for s in range(0, len(data) - 1, self.block):
            self.kept += [inner[b] for b in data[s : min(s + self.block, len(data) - 1)]]
            if len(self.kept) >= self.block:
                out += self._stable()
        return out

    def _stable(self) -> list[int]:
        tokens, limit, at, k = self.m.merge(self.kept), len(self.kept) - self.m.lookahead, 0, 0
        while k < len(tokens) and at + self.m.size[tokens[k]] <= limit:
            at, k = at + self.m.size[tokens[k]], k + 1
        self.kept = self.kept[at:]
        return tokens[:k]

    def close(self) -> list[int]:
        tokens = self.m.merge(self.kept + [self.m.last[b] for b in self.held])
        self.kept, self.held = [], b""
        return tokens


class _Memo(dict):
    def __init__(self, merges: Merges):
        self.m = merges

    def __missing__(self, piece: str) -> list[int]:
        if len(piece) > MEMO_CHARS:
            t = Transducer(self.m)
            return t.push(piece.encode()) + t.close()
        data = piece.encode()  # less than a block: all of it at once
        ids = tuple(self.m.merge([*map(self.m.inner.__getitem__, data[:-1]), self.m.last[data[-1]]]))
        if len(self) >= MEMO:
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """Streams texts to ids. One for each worker and file; holds no state between texts but the memo."""

    def __init__(self, merges: Merges, chunk: int = CHUNK, block: int = 0):
        self.m, self.chunk, self.block, self.memo = merges, chunk, block, _Memo(merges)
        self._cut = re.compile("|".join(map(re.escape, sorted(merges.special, key=len, reverse=True))) or r"(?!)")
        self._kinds: dict[str, str] = {}  # of signs that this Python's tables don't know yet
        self._known: set[str] = set()

    def encode(self, text: str | None) -> Iterator[list[int]]:
        """Blocks of ids."""
        at = 0
        for m in self._cut.finditer(text or ""):
            yield from self._segment(text[at : m.start()])
            yield [self.m.special[m[0]]]
            at = m.end()
        yield from self._segment((text or "")[at:])

    def _chunks(self, text: str) -> Iterator[tuple[str, bool]]:
        """Chunks of a text and whether each is the last. None begins with a sign that could be composed with the one before it."""
        at = 0
        while len(text) - at > self.chunk:
            end = text.rfind(" ", at + self.chunk // 2, at + self.chunk) + 1 or at + self.chunk
            while end < len(text) and (unicodedata.category(c := text[end])[0] == "M" or "ᄀ" <= c <= "ᇿ" or c > "￿"):
                end += 1
            if end >= len(text):
                break
            yield text[at:end], False
            at = end
        yield text[at:], True

    @functools.cache
    def _library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.m.file)

    def _normal(self, chunk: str) -> tuple[str, str]:
        """The chunk as pieces are cut from it, and a copy of equal length in which signs of unknown class are known ones."""
        if chunk.isascii():
            return (low := chunk.lower()), low
        if new := set(chunk) - self._known:
            self._known |= {c for c in new if unicodedata.category(c) != "Cn"}
            if new - self._known:  # signs newer than this Python's tables: their lower case and class are asked of the library
                low = self._library().normalizer.normalize_str(chunk)
                return low, "".join(map(self._kind, low))
        # letter by letter: a final sigma is like any other
        low = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        return low, low

    def _kind(self, c: str) -> str:
        if unicodedata.category(c) != "Cn":
            return c
        if c not in self._kinds:
            alone = lambda lead: len(self._library().pre_tokenizer.pre_tokenize_str(lead + c)) == 2
            self._kinds[c] = "z" if not alone("a") else "0" if alone("#") else "#"
        return self._kinds[c]

    def _segment(self, text: str) -> Iterator[list[int]]:
        rest, shadow_rest, run, piece = "", "", None, None
        for chunk, is_last in self._chunks(text):
            low, shadow = self._normal(chunk)
            low, shadow, at = rest + low, shadow_rest + shadow, 0
            rest = shadow_rest = ""
            if run:  # a run that the chunk before left open
                at = _GOES_ON[run].match(shadow).end()
                yield piece.push(low[:at].encode())
                if at == len(low) and not is_last:
                    continue
                yield piece.close()
                run = None
            if shadow is low and is_last:
                pieces = (_ASCII_PIECES if low.isascii() else _PIECES).findall(low, at)
                yield list(chain.from_iterable(map(self.memo.__getitem__, pieces)))
                continue
            spans = [m.span() for m in _PIECES.finditer(shadow, at)]
            if not is_last and spans and spans[-1][1] == len(shadow):
                start, end = spans[-1]
                before = spans[-2] if len(spans) > 1 else (0, 0)
                if shadow[start:end] == "'":  # may become a contraction
                    start = spans.pop()[0]
                    rest, shadow_rest = low[start:], shadow[start:]
                elif shadow[before[0] : end] in ("'r", "'v", "'l") and before[1] == start:
                    spans = spans[:-2]
                    rest, shadow_rest = low[before[0] :], shadow[before[0] :]
                elif not _DIGIT.match(shadow, start) and not (shadow[start] == "'" and _LETTER.match(shadow, end - 1)):
                    spans.pop()
                    run, piece = "letters" if _LETTER.match(shadow, start) else "signs", Transducer(self.m, self.block)
            yield list(chain.from_iterable(self.memo[low[a:b]] for a, b in spans))
            if run:
                yield piece.push(low[start:].encode())


class Decoder:
    """Ids to text, block by block. how: `tokens` (spellings joined by spaces) or `text` (bytes read as UTF-8, words parted by spaces)."""

    def __init__(self, merges: Merges, how: str = "tokens"):
        self.m, self.how, self.first = merges, how, True
        self.utf8, self.bytes = codecs.getincrementaldecoder("utf-8")("replace"), {c: b for b, c in enumerate(byte_alphabet())}

    def push(self, ids: Iterable[int]) -> str:
        """What the ids so far surely add. Ids that the vocabulary lacks are skipped."""
        names = self.m.names
        try:
            spelt = [names[i] for i in ids]
        except IndexError:
            spelt = [names[i] if i < len(names) else "" for i in ids]
        if self.how == "tokens":
            spelt = [x for x in spelt if x] if "" in spelt else spelt
            lead = "" if self.first or not spelt else " "
            self.first = self.first and not spelt
            return lead + " ".join(spelt)
        return "".join(map(self._text, spelt))

    def _text(self, name: str) -> str:
        if name in self.m.special:
            return self.utf8.decode(b"", True) + name
        word_end = bool(self.m.suffix) and name.endswith(self.m.suffix)
        body = name[: -len(self.m.suffix)] if word_end else name
        return self.utf8.decode(bytes(self.bytes[c] for c in body)) + (self.utf8.decode(b"", True) + " " if word_end else "")

    def close(self) -> str:
        return self.utf8.decode(b"", True) if self.how == "text" else ""


def read_file(path: str) -> str:
    with open(path, "rb") as f:
        data = f.read(MAX_FILE + 1)
    if len(data) > MAX_FILE:
        raise ValueError(f"{path} holds more than {MAX_FILE} bytes; it is sent to every worker")
    return data.decode()


@functools.cache
def _merges(file: str) -> Merges:
    return Merges(file)


@functools.cache
def _encoder(file: str) -> Encoder:
    return Encoder(_merges(file))


def _sent(df: DataFrame, path: str):
    file = read_file(path)
    _merges(file)  # refuses on the driver what can't be done
    return df.sparkSession.sparkContext.broadcast(file)


def encode(df: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """df and an array of the ids of its texts."""
    file = _sent(df, path)

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = _encoder(file.value)
        for s in texts:
            yield pd.Series([list(chain.from_iterable(e.encode(t))) for t in s], dtype=object)

    return df.withColumn(out, ids(F.col(f"`{text_col}`")))


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded", how: str = "tokens") -> DataFrame:
    """df and the text of its arrays of ids; see Decoder. A null array is empty."""
    file = _sent(df, path)

    @F.pandas_udf("string")
    def texts(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = _merges(file.value)
        for s in ids:
            out = []
            for x in s:
                d = Decoder(m, how)
                out.append(d.push([] if x is None else x) + d.close())
            yield pd.Series(out, dtype=object)

    return df.withColumn(out, texts(F.col(f"`{ids_col}`")))


def digests(text: Column, file) -> Column:
    """n_tokens, ids_sha256, decoded_sha256 of a text: ids are hashed and decoded as they are emitted, and none are kept."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e = _encoder(file.value)
        spelt = [str(i) for i in range(len(e.m.names))]
        for s in texts:
            rows = []
            for t in s:
                n, ids, words, back = 0, hashlib.sha256(), hashlib.sha256(), Decoder(e.m)
                for block in e.encode(t):
                    if block:
                        ids.update((" " * (n > 0) + " ".join([spelt[i] for i in block])).encode())
                        words.update(back.push(block).encode())
                        n += len(block)
                words.update(back.close().encode())
                rows.append((n, ids.hexdigest(), words.hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(text)


def op12_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every document's tokens and what they decode to, as digests. path: the vocabulary file (default: word_bpe_49k.json of the
    installed vocabularies). Null texts have no tokens; null and repeated ids are rows of their own."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    file = _sent(docs, path)
    return docs.select("doc_id", digests(F.col("text"), file).alias("d")).select("doc_id", "d.*")
