"""Byte-level BPE by Spark's higher-order functions.

A text is split by the vocabulary's pattern, and every word is an array of byte ids whose adjacent
parts are merged by rank until no pair has one: an ``aggregate`` folds the merges. Decoding
concatenates the binary pieces of the ids.

Distinct words of the corpus are counted, and the most frequent ones (``COMMON_WORDS`` at most,
whatever the corpus) are folded once, so that their ids are looked up. Words that are not among them
are folded where they stand. Which words are common has no influence on the ids. Texts are never
shuffled, only word counts are.

Long words are first cut between bytes that no piece of the vocabulary holds side by side, and parts
that are still long merge all places of the best pair in one step. This needs a vocabulary in which
every piece is reached by merges of rising rank; another one is refused.

Ranks of pairs and ids of common words are arrays in the one row of a scalar subquery: tasks get them
once, and no plan spells them out. A pair (a, b) stands at ``starts[a] + b``, where ``firsts`` says
whether that place is its own; a common word stands at the place its hash gives, or in a second array
if a more frequent word has that place.

Results for odd input: a null or empty text has no ids and decodes to no bytes; runs of white space,
control characters and strings of special tokens are ordinary text; words and texts of any length
are encoded whole (a word of n bytes without a cut costs n times the number of different merges);
ids outside the vocabulary and null ids decode to nothing; repeated rows, null document ids and
extra columns are carried along, a column with the name of the result is replaced; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import itertools
from collections import defaultdict
from collections.abc import Callable, Iterable, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightline.plans.durable import durable

#: Common words at most.
COMMON_WORDS = 1 << 18
#: Bytes up to which a word can be common and is merged one pair at a time.
SHORT_BYTES = 64

#: Bits of a word's hash that give its place in the first array of common words, and in the second.
PLACE_BITS = (19, 17)
#: Between the parts of a cut word, whose characters stand for bytes and end at U+00FF.
_CUT = "\u0100"
#: The sign of id 0, beyond the characters that are no text by themselves, and the sign of no rank.
_FIRST_SIGN, _NO_RANK = 0x10000, "\U0010ffff"

# White space, and the letters and numbers that were added to Unicode after version 13,
# which the regular expressions of older Java versions do not know.
_SPACE = r"\t-\r\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_NEW_LETTERS = """
870-887 889-88E 8B5 8C8-8C9 C5D CDD 170D 171F 1B4C 1C89-1C8A 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7CB-A7CD
A7D0-A7D1 A7D3 A7D5-A7DC A7F2-A7F4 10570-1057A 1057C-1058A 1058C-10592 10594-10595 10597-105A1
105A3-105B1 105B3-105B9 105BB-105BC 105C0-105F3 10780-10785 10787-107B0 107B2-107BA 10D4A-10D65
10D6F-10D85 10EC2-10EC4 10F70-10F81 11071-11072 11075 1123F-11240 11380-11389 1138B 1138E
11390-113B5 113B7 113D1 113D3 11740-11746 11AB0-11ABF 11BC0-11BE0 11F02 11F04-11F10 11F12-11F33
12F90-12FF0 1342F 13441-13446 13460-143FA 16100-1611D 16A70-16ABE 16D40-16D6C 18CFF 1AFF0-1AFF3
1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132 1B155 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E290-1E2AD
1E4D0-1E4EB 1E5D0-1E5ED 1E5F0 1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE 2A6DE-2A6DF
2B735-2B739 2EBF0-2EE5D 31350-323AF
"""
_NEW_NUMBERS = """
10D40-10D49 116D0-116E3 11BF0-11BF9 11F50-11F59 16130-16139 16AC0-16AC9 16D70-16D79 1CCF0-1CCF9
1D2C0-1D2D3 1E4F0-1E4F9 1E5F1-1E5FA
"""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    The body is the last step of a fold over nothing: unlike a transform of one element, it is
    evaluated without asking for its type again, which nested bodies would pay for at every row.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, body)


def either(condition: Column, yes: Column, no: Column) -> Column:
    """One of two values; a CASE looks its branches up in a list at every row."""
    return F.call_function("if", condition, yes, no)


# --- vocabulary -------------------------------------------------------------------------------


@functools.cache
def read_ranks(path: str) -> Mapping[bytes, int]:
    """Pieces and ranks of a vocabulary file with one base64 piece and one rank a line."""
    with open(path, "rb") as file:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}


def merged_in_order(piece: bytes, ranks: Mapping[bytes, int]) -> bool:
    """True if merging the bytes of ``piece`` by rank gives the piece, by ranks that only rise."""
    parts, last = [piece[i : i + 1] for i in range(len(piece))], -1
    while len(parts) > 1:
        best, at = min((ranks.get(a + b, len(ranks) + len(piece) + i), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        merged = parts[at] + parts[at + 1]
        if merged not in ranks or best < last:
            return False
        parts[at : at + 2], last = [merged], best
    return True


@functools.cache
def _checked(path: str) -> Mapping[bytes, int]:
    ranks = read_ranks(path)
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("this vocabulary lacks single bytes")
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("the ranks of this vocabulary are not the numbers from 0 on")
    if len(ranks) >= ord(_NO_RANK) - _FIRST_SIGN:
        raise ValueError("this vocabulary has more pieces than there are signs")
    if not all(merged_in_order(piece, ranks) for piece in ranks):
        raise ValueError("this vocabulary has pieces that merges of rising rank do not reach")
    return ranks


def _class(*ranges: str) -> str:
    ends = (r.split("-") for text in ranges for r in text.split())
    return "".join("-".join(rf"\x{{{e}}}" for e in pair) for pair in ends)


def java_pattern(pattern: str) -> str:
    """A splitting pattern for Java's regular expressions, with the same classes of characters."""
    # The range ahead of the new characters is all that most other characters are compared with.
    letters = rf"a-zA-Z\p{{L}}[\x{{870}}-\x{{10FFFF}}&&[{_class(_NEW_LETTERS)}]]"
    numbers = rf"\p{{N}}[\x{{10D40}}-\x{{10FFFF}}&&[{_class(_NEW_NUMBERS)}]]"
    inside = {r"\s": _SPACE, r"\p{L}": letters, r"\p{N}": numbers}
    alone = {r"\s": f"[{_SPACE}]", r"\S": f"[^{_SPACE}]", r"\p{L}": f"[{letters}]", r"\p{N}": f"[{numbers}]"}
    out, at, depth = [], 0, 0
    while at < len(pattern):
        known = next((k for k in (inside if depth else alone) if pattern.startswith(k, at)), None)
        if known:
            out.append((inside if depth else alone)[known])
            at += len(known)
            continue
        if pattern[at] == "\\":
            out.append(pattern[at : at + 2])
            at += 2
            continue
        depth += (pattern[at] == "[") - (pattern[at] == "]")
        out.append(pattern[at])
        at += 1
    return "".join(out)


# --- arrays that tasks look things up in ------------------------------------------------------


def with_arrays(
    df: DataFrame, arrays: Mapping[str, pa.Array], name: str, body: Callable[[Mapping[str, Column]], Column]
) -> DataFrame:
    """``df`` with ``body`` of the arrays as the column ``name``.

    The arrays are the one row of a scalar subquery. It is named once, so that the optimizer puts it
    where its name stands, and no row of the table carries the arrays.
    """
    lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in arrays.values()]
    row = df.sparkSession.createDataFrame(pa.table({"held": pa.StructArray.from_arrays(lists, list(arrays))}))
    held = next(h for h in map("_held{}".format, itertools.count()) if h not in df.columns)

    def bind(names: list[str], struct: Column, bound: dict[str, Column]) -> Column:
        if not names:
            return body(bound)
        return let(struct[names[0]], lambda array: bind(names[1:], struct, bound | {names[0]: array}))

    made = let(F.col(held), lambda struct: bind(list(arrays), struct, {}))
    return df.withColumn(held, row.scalar()).select(*[c for c in df.columns if c != name], made.alias(name))


def literal_list(values: Iterable[str]) -> Column:
    return F.split(F.lit(",".join(values)), ",")


def _placed(rows: Mapping[int, Mapping[int, int]], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``starts``, ``firsts`` and ``ranks`` of pairs: rows are laid over each other without a clash."""
    used, starts = bytearray(2 * most), np.zeros(most, np.int32)
    free = size = 0
    for first, row in sorted(rows.items(), key=lambda entry: -len(entry[1])):
        if len(row) != size:
            # Only short rows look for holes between what longer ones have used.
            size, free = len(row), free if len(row) > 2 else 0
        least, *rest = sorted(row)
        rest = [second - least for second in rest]
        at = used.find(0, max(free, least))
        while any(used[at + gap] for gap in rest):
            at = used.find(0, at + 1)
        free = max(free, at)
        # Room for one more row behind what is used.
        used.extend(bytes(max(0, at + 2 * most - len(used))))
        for gap in (0, *rest):
            used[at + gap] = 1
        starts[first] = at - least
    size = used.rfind(1) + 1
    firsts, ranks = np.full(size, -1, np.int32), np.zeros(size, np.int32)
    for first, row in rows.items():
        for second, rank in row.items():
            firsts[starts[first] + second], ranks[starts[first] + second] = first, rank
    return starts, firsts, ranks


@functools.cache
def _arrays(path: str) -> Mapping[str, pa.Array]:
    """Ids of the bytes, ranks of pairs of ids, and which bytes stand side by side in a piece; signs of ids."""
    pieces = _checked(path)
    rows: dict[int, dict[int, int]] = defaultdict(dict)
    beside = np.zeros(1 << 16, bool)
    for piece, rank in pieces.items():
        for i in range(1, len(piece)):
            beside[piece[i - 1] << 8 | piece[i]] = True
            left, right = pieces.get(piece[:i]), pieces.get(piece[i:])
            if left is not None and right is not None:
                rows[left][right] = rank
    starts, firsts, ranks = _placed(rows, len(pieces))
    singles = np.array([pieces[bytes([b])] for b in range(256)], np.int32)
    signs = [chr(_FIRST_SIGN + rank) for rank in range(len(pieces))]
    found = {"singles": singles, "starts": starts, "firsts": firsts, "ranks": ranks, "beside": beside, "signs": signs}
    return {name: pa.array(values) for name, values in found.items()}


# --- merges -----------------------------------------------------------------------------------


def bytes_of(word: Column) -> Column:
    """The bytes of a text as a text of as many characters, U+0000 to U+00FF."""
    return F.decode(word.cast("binary"), "ISO-8859-1")


class Merges:
    """The folds of a vocabulary as column expressions, from words to arrays of ids.

    Words and parts of words stand as texts with one character a byte.
    """

    def __init__(self, path: str, bound: Mapping[str, Column]) -> None:
        self._most = len(read_ranks(path))
        self._bound = bound

    @classmethod
    def bound(cls, path: str, body: Callable[[Merges], Column]) -> Callable[[DataFrame, str], DataFrame]:
        """``body`` of the folds of a checked vocabulary file, as a column to put into a table."""
        arrays = _arrays(path)
        return lambda df, name: with_arrays(df, arrays, name, lambda bound: body(cls(path, bound)))

    def _singles(self, word: Column) -> Column:
        return F.transform(F.split(word, ""), lambda byte: F.get(self._bound["singles"], F.ascii(byte)))

    def rank(self, left: Column, right: Column) -> Column:
        """The rank of two parts side by side, which is also the id of both as one; null without one."""
        return let(
            F.get(self._bound["starts"], left) + right,
            lambda at: either(F.get(self._bound["firsts"], at) == left, F.get(self._bound["ranks"], at), F.lit(None)),
        )

    def _pair_ranks(self, parts: Column) -> Column:
        # The first list has one part more, whose partner is null, and so its rank.
        return F.zip_with(parts, F.slice(parts, F.lit(2), F.size(parts)), self.rank)

    def short(self, word: Column) -> Column:
        """One merge a step, the leftmost pair of the least rank.

        Ids and ranks are single characters of two texts, whose order is that of the numbers: texts
        are cut and joined far quicker than arrays.
        """
        none = F.lit(_NO_RANK)

        def number(sign: Column) -> Column:
            return F.ascii(sign) - _FIRST_SIGN

        def rank(left: Column, right: Column) -> Column:
            return F.coalesce(F.get(self._bound["signs"], self.rank(number(left), number(right))), none)

        def state(parts: Column, ranks: Column) -> Column:
            return let(
                ranks,
                lambda held: F.struct(
                    parts.alias("parts"), held.alias("ranks"), F.array_min(F.split(held, "")).alias("best")
                ),
            )

        def merge(parts: Column, ranks: Column, at: Column, piece: Column) -> Column:
            rest = F.length(parts)
            right = rank(piece, F.substring(parts, at + 2, F.lit(1)))
            left = rank(F.substring(parts, at - 1, F.lit(1)), piece)
            return state(
                F.concat(F.substring(parts, F.lit(1), at - 1), piece, F.substring(parts, at + 2, rest)),
                F.concat(
                    either(at == 1, right, F.concat(F.substring(ranks, F.lit(1), at - 2), left, right)),
                    F.substring(ranks, at + 2, rest),
                ),
            )

        def step(held: Column, _: Column) -> Column:
            best = held["best"]
            merged = let(F.instr(held["ranks"], best), lambda at: merge(held["parts"], held["ranks"], at, best))
            return either(best == none, held, merged)

        def start(signs: Column) -> Column:
            # The last sign has no partner, and so no rank.
            ranks = F.transform(signs, lambda sign, at: rank(sign, F.get(signs, at + 1)))
            return F.aggregate(
                signs,
                state(F.array_join(signs, ""), F.array_join(ranks, "")),
                step,
                lambda held: F.transform(F.split(held["parts"], ""), number),
            )

        return let(F.transform(self._singles(word), lambda single: F.get(self._bound["signs"], single)), start)

    def long(self, word: Column) -> Column:
        """All places of the pair of the least rank a step; ids stand in brackets in one text."""

        def parts_of(text: Column) -> Column:
            return F.split(F.substring(text, F.lit(2), F.length(text) - 2), "><").cast("array<int>")

        def merge(state: Column, parts: Column, ranks: Column, at: Column) -> Column:
            pair = F.concat(F.lit("<"), F.get(parts, at - 1), F.lit("><"), F.get(parts, at), F.lit(">"))
            one = F.concat(F.lit("<"), F.get(ranks, at - 1), F.lit(">"))
            return F.struct(F.replace(state["text"], pair, one).alias("text"), F.lit(False).alias("done"))

        def step(state: Column, _: Column) -> Column:
            def best(parts: Column, ranks: Column) -> Column:
                return let(
                    F.array_position(ranks, F.array_min(ranks)).cast("int"),
                    lambda at: F.when(at > 0, merge(state, parts, ranks, at)).otherwise(
                        F.struct(state["text"].alias("text"), F.lit(True).alias("done"))
                    ),
                )

            def found(parts: Column) -> Column:
                return let(self._pair_ranks(parts), lambda ranks: best(parts, ranks))

            return F.when(state["done"], state).otherwise(let(parts_of(state["text"]), found))

        singles = F.array_join(self._singles(word).cast("array<string>"), "><")
        return F.aggregate(
            F.sequence(F.lit(1), F.least(F.length(word), F.lit(self._most))),
            F.struct(F.concat(F.lit("<"), singles, F.lit(">")).alias("text"), F.lit(False).alias("done")),
            step,
            lambda state: parts_of(state["text"]),
        )

    def cut(self, word: Column) -> Column:
        """A word, cut where no piece holds the bytes on both sides."""

        def marked(byte: Column, after: Column) -> Column:
            together = F.get(self._bound["beside"], F.ascii(byte) * 256 + F.ascii(after))
            return F.when(after.isNull() | together, byte).otherwise(F.concat(byte, F.lit(_CUT)))

        def joined(parts: Column) -> Column:
            after = F.slice(parts, F.lit(2), F.size(parts))
            return F.split(F.array_join(F.zip_with(parts, after, marked), ""), _CUT)

        return let(F.split(word, ""), joined)

    def ids(self, word: Column) -> Column:
        """Ids of a word that is not empty."""

        def part_ids(part: Column) -> Column:
            return F.when(F.length(part) <= SHORT_BYTES, self.short(part)).otherwise(self.long(part))

        return F.when(F.length(word) <= SHORT_BYTES, self.short(word)).otherwise(
            F.flatten(F.transform(self.cut(word), part_ids))
        )


def _place(hashed: Column, bits: int) -> Column:
    return F.shiftrightunsigned(hashed, 64 - bits).cast("int")


def common_words(words: DataFrame, ranks_path: str, most: int = COMMON_WORDS) -> dict[str, pa.Array]:
    """At most ``most`` words (column ``word``) with their ids: all that occur often enough.

    The arrays ``common0``, ``common1`` hold a word at the place its hash gives; where words meet,
    the most frequent one stays, and of those that meet in the second array the others are left out.
    """
    counted = durable(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    known = counted.filter(F.octet_length("word") <= SHORT_BYTES)
    # A few hundred steps of frequency at most; the last one that still fits is the limit.
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(((r.step, r.n) for r in known.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    fitting = [at for (at, _), total in zip(sizes, itertools.accumulate(n for _, n in sizes)) if total <= most]
    if not fitting:
        return {}
    common = known.filter(step >= fitting[-1]).repartition("word")
    folded = Merges.bound(ranks_path, lambda merges: merges.short(bytes_of(F.col("word"))))
    left = folded(common, "ids").select("word", "ids", F.xxhash64("word").alias("hash"), "n").toArrow()
    left = left.sort_by([("n", "descending"), ("word", "ascending")])
    arrays = {}
    for at, bits in enumerate(PLACE_BITS):
        hashed = left.column("hash").to_numpy().view(np.uint64)
        places, rows = np.unique(hashed << np.uint64(at * PLACE_BITS[0]) >> np.uint64(64 - bits), return_index=True)
        taken = np.full(1 << bits, -1)
        taken[places] = rows
        pick = pa.array(taken, mask=taken < 0)
        word, ids_ = (left.column(name).combine_chunks().take(pick) for name in ("word", "ids"))
        arrays[f"common{at}"] = pa.StructArray.from_arrays([word, ids_], ["word", "ids"])
        left = left.take(np.setdiff1d(np.arange(left.num_rows), rows))
    return arrays


def common_ids(word: Column, bound: Mapping[str, Column]) -> Column:
    """Ids of a common word, null for another."""

    def found(array: str, place: Column) -> Column:
        return let(F.get(bound[array], place), lambda entry: either(entry["word"] == word, entry["ids"], F.lit(None)))

    def looked_up(hashed: Column) -> Column:
        first, second = PLACE_BITS
        return F.coalesce(
            found("common0", _place(hashed, first)), found("common1", _place(F.shiftleft(hashed, first), second))
        )

    return let(F.xxhash64(word), looked_up)


def encode_documents(
    df: DataFrame, ranks_path: str, pattern: str, *, text: str = "text", ids: str = "ids", most: int = COMMON_WORDS
) -> DataFrame:
    """``df`` with the ids of the text in place of the column ``ids``, an array of integers."""
    split = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))
    common = common_words(df.select(F.explode(split).alias("word")), ranks_path, most)

    def word_ids(word: Column, bound: Mapping[str, Column]) -> Column:
        folded = let(bytes_of(word), Merges(ranks_path, bound).ids)
        return F.coalesce(common_ids(word, bound), folded) if common else folded

    arrays = {**_arrays(ranks_path), **common}
    return with_arrays(df, arrays, ids, lambda bound: F.flatten(F.transform(split, lambda w: word_ids(w, bound))))


def packed_ids(ids: Column, ranks_path: str) -> Column:
    """Ids as little-endian unsigned 32-bit integers."""
    digits = literal_list(r.to_bytes(4, "little").hex() for r in range(len(read_ranks(ranks_path))))
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(digits, i)), ""))


def decode_documents(df: DataFrame, ranks_path: str, *, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the bytes its ids stand for in place of the column ``decoded``."""
    ranks = read_ranks(ranks_path)
    pieces = literal_list(p.hex() for p in sorted(ranks, key=ranks.__getitem__))
    joined = F.array_join(F.transform(F.coalesce(F.col(ids), F.array().cast("array<int>")), lambda i: F.get(pieces, i)), "")
    return df.select(*[c for c in df.columns if c != decoded], F.unhex(joined).alias(decoded))
