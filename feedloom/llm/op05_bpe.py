"""BPE encoding and decoding by depth-first traversal of the trie of distinct words."""

from __future__ import annotations

import json
import struct
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# fixed values of the vocabulary file's own pre-tokenizer and of Unicode's White_Space
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"

#: ASCII that is neither letter, digit nor white space.
MARKS = "".join(c for c in map(chr, range(128)) if not c.isalnum() and c not in "\t\n\x0b\x0c\r ")

END = "</w>"
#: Bytes, about, that the encodings of chunks between white space take in each of a Python worker's two generations of them; pairs
#: of tokens whose border is remembered.
CACHE, BORDERS = 48 << 20, 250_000
#: Letters from which a word's states are worked out from the front, without recursion.
DEEP = 200
#: Texts in a piece of work: the more, the more prefixes are shared.
SLICE = 1024


def byte_letters() -> list[str]:
    """The letter of each byte: printable Latin-1 bytes stand for themselves, the others for U+0100 and up, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Coder:
    """Encodes words of one vocabulary with word ends.

    For each prefix of a word, the state is the last token of the prefix's encoding. It is the only suffix t of
    the prefix such that t is a token and the last token before t and t stay apart when encoded together. So a
    prefix's state follows from those of shorter prefixes, and words share the states of their common prefix.
    """

    def __init__(self, text: str):
        import regex

        spec = json.loads(text)
        self.ids: dict[str, int] = dict(spec["model"]["vocab"])
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.longest = max(len(t.removesuffix(END)) for t in self.ids)
        self.letters = {b: c for b, c in enumerate(byte_letters()) if chr(b) != c}
        self.find = regex.compile(WORD_PATTERN.replace(r"\s", WHITE)).findall
        self.split_white = regex.compile(f"[{WHITE}]+").split
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.apart_memo: dict[tuple[str, str], bool] = {}
        self.whole_memo: dict[str, bool] = {}
        self.packed = {t: struct.pack("<I", i) for t, i in self.ids.items()}
        self.held = 0
        self.coded: dict[str, bytes] = {}
        self.said: dict[str, str] = {}
        self.old: tuple[dict[str, bytes], dict[str, str]] = {}, {}

    @staticmethod
    def symbols(token: str) -> list[str]:
        return [*token[: -len(END) - 1], token[-len(END) - 1 :]] if token.endswith(END) and len(token) > len(END) else list(token)

    def merge(self, parts: list[str]) -> list[str]:
        """Plain merging: the pair of least rank first, the leftmost of equals."""
        rank, parts = self.rank, list(parts)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get((parts[i], parts[i + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def apart(self, a: str, b: str) -> bool:
        known = self.apart_memo.get((a, b))
        if known is None:
            if len(self.apart_memo) > BORDERS:
                self.apart_memo.clear()
            known = self.apart_memo[a, b] = self.merge(self.symbols(a) + self.symbols(b)) == [a, b]
        return known

    def whole(self, t: str) -> bool:
        known = self.whole_memo.get(t)
        if known is None:
            known = self.whole_memo[t] = self.merge(self.symbols(t)) == [t]
        return known

    def encode_words(self, words) -> dict[str, list[str]]:
        """The tokens of each distinct word. Sorted words are the trie's depth-first order; tokens holds the path's states.

        A state is worked out when a longer prefix or a word first needs it, and stays while the path shares that prefix.
        """
        out: dict[str, list[str]] = {}
        ids, longest, memo, apart, whole = self.ids, self.longest, self.apart_memo, self.apart, self.whole
        before, tokens = "", [""]

        def last(word: str, i: int, end: str) -> tuple[str, int]:
            """The last token of the prefix of i letters (and end), and where it starts."""
            low = 0 if i <= longest else i - longest
            tail = word[low:i] + end
            for k in range(low, i):
                t = tail[k - low :]
                if t in ids:
                    if not k:
                        if whole(t):
                            return t, 0
                        continue
                    state = tokens[k]
                    if state is None:
                        state = tokens[k] = last(word, k, "")[0]
                    fits = memo.get((state, t))
                    if fits or fits is None and apart(state, t):
                        return t, k
            raise ValueError(f"no token ends {tail!r}")

        for word in sorted(words):
            n = len(word)
            most = min(len(before), n - 1, len(tokens) - 1)
            shared = 0
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del tokens[shared + 1 :]
            tokens += [None] * (n - 1 - shared)
            if n > DEEP:
                for i in range(1, n):
                    if tokens[i] is None:
                        tokens[i] = last(word, i, "")[0]
            t, k = last(word, n, END)
            chain = [t]
            while k > 0:
                t = tokens[k]
                chain.append(t)
                k -= len(t)
            chain.reverse()
            out[word] = chain
            before = word
        return out

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower-cased letter by letter: no final sigma
        return text.lower()

    def split(self, text: str) -> list[str]:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split, but not to Unicode
            return [x for x in self.split_white(text) if x]
        return text.split()

    def spell(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)

    def learn(self, fresh) -> None:
        """Adds chunks (of normal text, without white space) to the cache; those of the last generation move over.

        A word is a chunk of its own, so chunks that differ only in the marks around a word share its encoding.
        """
        coded, said = self.coded, self.said
        old_coded, old_said = self.old
        held = 0
        for c in fresh & old_coded.keys():
            coded[c], said[c] = old_coded[c], old_said[c]
            held += 300 + 2 * len(c) + len(coded[c]) + 2 * len(said[c])
        fresh -= old_coded.keys()
        words, parts, find = set(), {}, self.find
        for c in fresh:
            if c.isascii():
                letters = c.rstrip(MARKS)
                if letters.isalpha():
                    if len(letters) == len(c):
                        words.add(c)
                    else:
                        parts[c] = found = (letters, c[len(letters) :])
                        words.update(found)
                    continue
            found = find(c)
            if len(found) > 1:
                parts[c] = found
            words.update(found)
        words -= coded.keys()
        spelled = {w: self.spell(w) for w in words}
        known, packed = self.encode_words(spelled.values()), self.packed
        for w, spelling in spelled.items():
            tokens = known[spelling]
            coded[w] = a = b"".join([packed[t] for t in tokens])
            said[w] = b = " ".join(tokens)
            held += 300 + 2 * len(w) + len(a) + 2 * len(b)
        for c, found in parts.items():
            coded[c] = a = b"".join([coded[w] for w in found])
            said[c] = b = " ".join([said[w] for w in found])
            held += 300 + 2 * len(c) + len(a) + 2 * len(b)
        self.held += held

    def encode_texts(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """(ids as little-endian 32-bit integers, decoded text) of each text."""
        pieces = []
        for text in texts:
            text = text or ""
            if self.special and "<|" in text:
                pieces.append([s if i % 2 else self.split(self.normal(s)) for i, s in enumerate(self.split_special(text))])
            else:
                pieces.append([self.split(self.normal(text))])
        if self.held > CACHE:
            self.old, self.coded, self.said, self.held = (self.coded, self.said), {}, {}, 0
        fresh = set()
        for p in pieces:
            for x in p[::2]:
                fresh.update(x)
        self.learn(fresh - self.coded.keys())
        coded, said, out = self.coded.__getitem__, self.said.__getitem__, []
        for p in pieces:
            if len(p) == 1:
                out.append((b"".join(map(coded, p[0])), " ".join(map(said, p[0]))))
                continue
            a, b = [], []
            for i, x in enumerate(p):
                if i % 2:
                    a.append(struct.pack("<I", self.special[x]))
                    b.append(x)
                else:
                    a += map(coded, x)
                    b += map(said, x)
            out.append((b"".join(a), " ".join(b)))
        return out


_CODERS: dict[int, Coder] = {}


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every row: ids are little-endian unsigned 32-bit integers, decoded joins the tokens.

    vocabulary is the path of a tokenizers file: BPE with word ends over bytes, without a decoder; the driver
    reads it and broadcasts it (its size is fixed). Each task works on a few hundred texts at a time, keeps a
    bounded cache and moves no rows. Null and empty texts give no ids and an empty string; repeated rows repeat;
    an empty table gives no rows; a word may be as long as the text; further columns are ignored.
    """
    spark = df.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        text = f.read()
    shared = spark.sparkContext.broadcast(text)
    mark = hash(text)

    def work(batches):
        import pyarrow as pa

        coder = _CODERS.get(mark)
        if coder is None:
            _CODERS.clear()
            coder = _CODERS[mark] = Coder(shared.value)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, SLICE)
                at += SLICE
                found = coder.encode_texts(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.string())], names=["doc_id", "ids", "decoded"])
                del found
                common.give_back()  # a piece's words and tokens take more than the caches

    kind = df.schema[id_col].dataType.simpleString()
    return common.arrow_map(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), work, f"doc_id {kind}, ids binary, decoded string")


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """df with the column decoded, from ids alone: the tokens joined by a space."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    shared = df.sparkSession.sparkContext.broadcast(names)

    @F.pandas_udf("string")
    def tell(ids):
        table = shared.value
        return ids.map(lambda x: None if x is None else " ".join(table[i] for (i,) in struct.iter_unpack("<I", x)))

    return df.withColumn("decoded", tell(F.col(ids_col)))


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(common.read(spark, sf_dir, "documents"), vocabulary_path())
    return coded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
