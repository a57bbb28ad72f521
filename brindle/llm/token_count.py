"""Token counts by the whole-token shortcut.

Offline, for every vocabulary string it is proved by the merges themselves whether the string alone encodes as one
token. A text is cut into pre-tokens by the tokenizer's own pattern; those in the proven set count one, and only the
rest are merged (each distinct one once, in a bounded memo).

Defined results: null and empty texts have no tokens; special strings inside texts are one token each, which is the
library's default; whole texts are counted, of any length, without truncation; repeated rows are counted one by one; an
empty table gives an empty table; further columns don't disturb.
"""

from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from brindle.llm import kernel
from brindle.llm.common import table

#: The split of byte-level BPE, as the tokenizer file names it by "use_regex": fixed by the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in shown else next(free)) for b in range(256)]


class WholeTokens:
    """Counts tokens of byte-level BPE files of the tokenizers library. Made from the file's content, so that workers
    need no path; special strings are those the file declares as added tokens."""

    #: Entries of the memo of merged pre-tokens, after which it starts anew; longer pre-tokens are merged each time.
    MEMO = 200_000
    MEMO_LENGTH = 64

    def __init__(self, content: str, proven: list[str] | None = None):
        import regex
        from tokenizers import Tokenizer

        spec = json.loads(content)
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only byte-level BPE without normalizer and prefix space is supported")
        self.model = Tokenizer.from_str(content).model
        self.find = regex.compile(PATTERN).findall
        self.letters = byte_letters()
        special = [t["content"] for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in white space aren't supported")
        self.split = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))).split if special else None
        self.proven = self.prove(spec["model"]["vocab"]) if proven is None else proven
        self.fresh()

    def prove(self, vocabulary) -> list[str]:
        """Vocabulary strings that are a pre-token by themselves and merge to exactly one token."""
        back = {c: b for b, c in enumerate(self.letters)}
        out = []
        for token in vocabulary:
            if not all(c in back for c in token):
                continue
            try:
                text = bytes(back[c] for c in token).decode()
            except UnicodeDecodeError:
                continue
            if self.find(text) == [text] and len(self.model.tokenize(token)) == 1:
                out.append(text)
        return out

    def fresh(self) -> None:
        merge, longest = self.merge, self.MEMO_LENGTH

        class Memo(dict):
            def __missing__(memo, text):
                n = merge(text)
                if len(text) <= longest:
                    memo[text] = n
                return n

        self.memo = Memo.fromkeys(self.proven, 1)

    def merge(self, text: str) -> int:
        return len(self.model.tokenize("".join([self.letters[b] for b in text.encode()])))

    def count(self, text: str) -> int:
        parts = self.split(text) if self.split else [text]
        if len(self.memo) > self.MEMO + len(self.proven):
            self.fresh()
        return len(parts) - 1 + sum(sum(map(self.memo.__getitem__, self.find(p))) for p in parts)


def token_counts(docs: DataFrame, content: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for docs (doc_id, text). The vocabulary (its size is the file's, about
    2 MB) and the proven set go along with the function."""
    proven = WholeTokens(content).proven
    ids = [f for f in docs.schema.fields if f.name == "doc_id"]

    def run(batches):
        counter = WholeTokens(content, proven)
        for batch in batches:
            for piece in kernel.pieces(batch):
                texts = pc.fill_null(piece.column("text"), "")
                n = [counter.count(t) for t in texts.to_pylist()]
                columns = [piece.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    schema = T.StructType([*ids, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op8_whole_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """path: the tokenizer file, by default byte_bpe_50k.json of the public tokenizers; read on the driver."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        content = f.read()
    return token_counts(table(spark, sf_dir, "documents"), content)
