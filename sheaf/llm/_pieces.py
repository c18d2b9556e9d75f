"""A sentencepiece model of kind BPE: its normalised words, its pieces and the pairs that merge.

No piece holds a white space mark after another character, so no merge crosses from a word into the
next; a text's words (each with the marks before it) can be encoded on their own, equal words once.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = "▁"
NONE = np.int32(2**31 - 1)
_RUN = re.compile(f"{MARK}+[^{MARK}]*")


class Pieces:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        kinds = proto.ModelProto.SentencePiece
        if train.model_type != proto.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or train.treat_whitespace_as_suffix or not train.byte_fallback:
            raise ValueError("only BPE models with identity normalisation, a dummy prefix and byte fallback are supported")
        if any(p.type == kinds.USER_DEFINED or p.type == kinds.UNUSED or MARK in p.piece.lstrip(MARK) and p.type == kinds.NORMAL for p in model.pieces):
            raise ValueError("a piece of this model has no counterpart here")
        ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.bos, self.eos, self.unk = train.bos_id, train.eos_id, train.unk_id
        self.byte_ids = np.zeros(256, np.int32)
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
        size = len(model.pieces)
        #: Symbols from size on are characters without a piece of their own.
        extra = {c: size + 1 + k for k, c in enumerate(sorted({c for p in ids for c in p} - set(ids)))}
        self.size, self.other = size, size
        self.symbol = np.full(0x110000, self.other, np.int32)
        for c, i in [*ids.items(), *extra.items()]:
            if len(c) == 1:
                self.symbol[ord(c)] = i
        scores = sorted({-model.pieces[i].score for i in ids.values()})
        rank = {s: k for k, s in enumerate(scores)}
        known = ids | extra
        left, right, merged, ranks = [], [], [], []
        for p, i in ids.items():
            for cut in range(1, len(p)):
                if (a := known.get(p[:cut])) is not None and (b := known.get(p[cut:])) is not None:
                    left.append(a), right.append(b), merged.append(i), ranks.append(rank[-model.pieces[i].score])
        self.bits = max(12, (len(left) * 4).bit_length())
        keys = (np.array(left, np.uint64) << np.uint64(20)) | np.array(right, np.uint64)
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.merged, self.ranks = np.zeros(1 << self.bits, np.int32), np.full(1 << self.bits, NONE)
        slots = self._slot(keys).astype(int)
        for key, slot, m, r in zip(keys, slots, merged, ranks):
            while self.keys[slot] != 2**64 - 1:
                slot = slot + 1 & (1 << self.bits) - 1
            self.keys[slot], self.merged[slot], self.ranks[slot] = key, m, r

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(17))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What adjacent symbols merge to, and its rank (NONE: they don't merge)."""
        keys = (left.astype(np.uint64) << np.uint64(20)) | right.astype(np.uint64)
        slot = self._slot(keys).astype(np.int64)
        found = self.keys[slot]
        wait = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        while len(wait):
            slot[wait] = slot[wait] + 1 & (1 << self.bits) - 1
            found = self.keys[slot[wait]]
            wait = wait[(found != keys[wait]) & (found != np.uint64(2**64 - 1))]
        hit = self.keys[slot] == keys
        return np.where(hit, self.merged[slot], 0), np.where(hit, self.ranks[slot], NONE)


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def distinct_words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of a string column, each without its first mark; the word of each place; each text's first place."""
    column = column.fill_null("") if column.null_count else column
    split = pc.split_pattern(column, " ")
    odd = pc.match_substring_regex(column, f"^ |  | $|{MARK}").to_numpy(zero_copy_only=False)
    empty = pc.equal(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    if odd.any() or empty.any():
        rows = []
        for i in range(len(column)):
            if empty[i]:
                rows.append([])
            elif odd[i]:
                rows.append([w[1:] for w in _RUN.findall(MARK + column[i].as_py().replace(" ", MARK))])
            else:
                rows.append(None)
        plain = pa.array(np.flatnonzero(~(odd | empty)))
        special = pa.array([r for r in rows if r is not None], pa.list_(pa.string()))
        order = np.empty(len(column), np.int64)
        order[~(odd | empty)] = np.arange(len(plain))
        order[odd | empty] = len(plain) + np.arange(len(special))
        split = pa.concat_arrays([split.take(plain), special]).take(pa.array(order))
    first = split.offsets.to_numpy().astype(np.int64)
    coded = split.values[first[0] : first[-1]].dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), first - first[0]


def characters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words with a mark put before each, and where each word starts in them."""
    lens = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    joined = MARK.join(["", *words.to_pylist()])
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum(lens)])


def utf8_size(points: np.ndarray) -> np.ndarray:
    return 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The concatenation of flat[s : s + n]."""
    ends = np.cumsum(lens)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)]


def apart(model: Pieces, hit: np.ndarray, sym: np.ndarray, to: np.ndarray, word: np.ndarray, after: np.ndarray, before: np.ndarray, rank: int | np.ndarray, nowhere: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of one rank each word can merge at once, and which must wait.

    hit: places of pairs, rising; rank: theirs, one for all or one for each. Of pairs that overlap in a row every
    second one goes, from the left. Where a merge makes a pair that doesn't come after this rank, its word's leftmost
    pair goes alone: the new one is due before the others.
    """
    alone = np.ones(len(hit), bool)
    alone[1:] = word[hit[1:]] != word[hit[:-1]]
    several = np.zeros(len(hit), bool)  # in a word with more than one
    several[:-1] = ~alone[1:]
    several |= ~alone
    if not several.any():
        return hit, hit[:0]
    linked = np.zeros(len(hit), bool)
    linked[1:] = after[hit[:-1]] == hit[1:]
    place = np.arange(len(hit))
    run = np.maximum.accumulate(np.where(linked, 0, place))
    keep = (place - run) % 2 == 0
    i = hit[keep]
    far = after[after[i]]
    prev = before[i]
    made = to[i]
    r = rank if np.ndim(rank) == 0 else rank[keep]
    next_too = np.append(far[:-1] == i[1:], False)
    prev_too = np.append(False, far[:-1] == i[1:])
    least = np.full(len(i), NONE)
    for left, right, there in ((made, sym[far], far != nowhere), (made, np.append(made[1:], 0), next_too), (sym[prev], made, (prev != nowhere) & ~prev_too)):
        at = np.flatnonzero(there & several[keep])
        if len(at):
            least[at] = np.minimum(least[at], model.pairs(left[at], right[at])[1])
    early = least <= r
    if early.any():
        held = np.isin(word[i], word[i[early]])
        keep[np.flatnonzero(keep)[held & ~alone[keep]]] = False
    return hit[keep], hit[~keep]
