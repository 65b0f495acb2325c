"""Token counts: batch encoding in Arrow functions that return lengths only.

Long texts are cut at spaces and line ends, where no token of a tokenizer that drops white space can cross; cuts of all
texts of an Arrow batch are then dealt into encoding batches of about `BATCH_BYTES`, however long a single text is. A
batch encodes each distinct word once, plain words (letters, then marks) by the library's model and the rest by one batch
call; lengths of the first words seen stay in a table with a fixed number of places.

Null and empty texts have 0 tokens and 0 bytes. Rows that repeat are counted each, an empty table gives an empty one.
Only key and text are read, so further columns and their names do not matter. No shuffle; a scan deals rows by bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.llm.tokens import in_vocabulary, letters_and_marks, tokenizer_of

#: Characters of text in an encoding batch, and after how many a long text is cut.
BATCH_BYTES, CUT = 1 << 20, 1 << 18
#: Pieces whose length a worker remembers.
KNOWN = 500_000
#: Where the tokenizer drops white space, any of these ends a token.
_SAFE = re.compile(r"[ \n\r\t]")


def cut_safely(text: str, most: int = CUT) -> Iterator[str]:
    """The text in parts of about `most` characters, cut at white space; a run without any is not cut."""
    low = 0
    while len(text) - low > most:
        found = _SAFE.search(text, low + most)
        if not found:
            break
        yield text[low:found.start()]
        low = found.end()
    yield text[low:] if low else text


class Lengths:
    def __init__(self, path: str, known: int = KNOWN):
        self.tokenizer = tokenizer_of(path)
        self.known: dict[str, int] = {}
        self.marks: dict[str, int] = {"": 0}
        self.limit = known

    def lengths(self, words: list[str]) -> dict[str, int]:
        """Tokens of each word. A run of letters is one piece for the pattern, a run of marks behind it another."""
        found: dict[str, int] = {}
        rest, model = [], self.tokenizer.model
        for word in words:
            parts = letters_and_marks(word)
            if parts is None:
                rest.append(word)
                continue
            letters, marks = parts
            if letters not in found:
                found[letters] = len(model.tokenize(in_vocabulary(letters.lower())))
            if marks not in self.marks:
                self.marks[marks] = len(self.tokenizer.encode(marks, add_special_tokens=False))
            found[word] = found[letters] + self.marks[marks]
        for low in range(0, len(rest), 4096):
            part = rest[low:low + 4096]
            found.update(zip(part, map(len, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        return found

    def count(self, parts: list[str]) -> list[int]:
        """Tokens of each part, by one batch call for the pieces that aren't known."""
        cut = [p.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for p in parts]
        table = self.known
        new = list({w for words in cut for w in words if w not in table})
        if new:
            found = self.lengths(new)
            if len(table) + len(found) <= self.limit:
                table.update(found)
            else:
                found.update((w, table[w]) for words in cut for w in words if w in table)
                table = found
        return [sum(map(table.__getitem__, words)) for words in cut]


_LENGTHS: dict[str, Lengths] = {}


def token_counts(docs: DataFrame, tokenizer: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, `n_bytes` (UTF-8), `n_tokens` and `over_limit` of every text. For tokenizers that drop white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _LENGTHS:
            _LENGTHS[tokenizer] = Lengths(tokenizer)
        lengths = _LENGTHS[tokenizer]
        for batch in batches:
            texts = batch.column("text")
            total = [0] * batch.num_rows
            rows: list[int] = []
            parts: list[str] = []
            room = 0

            def settle():
                for row, n in zip(rows, lengths.count(parts), strict=True):
                    total[row] += n

            for row, value in enumerate(texts):
                for part in cut_safely(value.as_py() or ""):
                    if parts and room + len(part) > BATCH_BYTES:
                        settle()
                        rows, parts, room = [], [], 0
                    rows.append(row)
                    parts.append(part)
                    room += len(part)
            settle()
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), size, pa.array(total, pa.int64())],
                                             names=["key", "n_bytes", "n_tokens"])

    found = docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(
        run, f"key {docs.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long")
    return found.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), 2048)


QUERIES = {"op5_token_counts": op5_token_counts}
ORACLE: dict[str, str] = {}
