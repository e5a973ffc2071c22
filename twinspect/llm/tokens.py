"""Token counts by finite-state transducers compiled from a byte-level BPE vocabulary file.

Two deterministic machines are composed.

* The splitter reads classes of code points (13 states) and marks where pieces start; a mark may concern the character
  before, which stands for the pattern's lookahead. A batch of texts is cut into equal chunks. Each chunk's map from
  entry state to exit state is computed for all chunks side by side (after one character at most a few states are left
  to follow), the maps are composed by a parallel prefix scan, and that gives every chunk its entry state.
* The counter reads the bytes of one piece, and each transition carries how the number of tokens changes. A state is what
  decides the future: the longest suffix that starts some token, and for every position in it where a token could start
  the kind of the last token and the relative count of the encoding up to there. A byte extends an encoding by the one token whose predecessor it can
  follow (two tokens can stand together if no merge across their joint comes before those that make them). States are made when first
  met; a piece met before is a single stored transition. Both stores are emptied when they reach a bound. A piece
  longer than LONG_PIECE is cut into chunks, whose maps from entry state to exit state and tokens are composed pair by
  pair in a balanced tree; a map is filled for the entry states that occur, and equal stretches share one.

A text longer than BATCH_CHARS is split in windows. The last pieces of a window, which what follows may change, open the
next one, so that the arrays of a window are all that is held beside the text.

Defined cases: null and empty texts have 0 tokens; a special string inside a text is one token and splits the text, as
the vocabulary's library does by default; texts of any length are counted whole, also those of a single piece; repeated rows are counted each.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspect.session import load

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
BATCH_CHARS = 2_000_000
CHUNK = 256
MEMO_MAX = 400_000
STATES_MAX = 400_000
NEVER = 1 << 60
MEMO_PIECE = 64
LONG_PIECE = 2_048
SEGMENT = 1 << 20
SPARE = 4  # pieces at a window's end that more text may change, contractions and white space included

# The code points that Unicode lists as White_Space.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

CLASSES = ("reset", "letter", "single", "r", "v", "l", "e", "number", "apostrophe", "other", "space", "white")
LETTERS = ("letter", "single", "r", "v", "l", "e")
STATES = ("START", "LET", "NUM", "OTH", "APO", "AR", "AV", "AL", "CON", "SP1", "W1", "SPM", "WM")
HERE, BACK = 1, 2  # a piece starts at this character; at the one before


def _step(state: str, kind: str) -> tuple[str, int]:
    """The splitter's next state and marks."""
    if state in ("AR", "AV", "AL"):
        if kind == {"AR": "e", "AV": "e", "AL": "l"}[state]:
            return "CON", 0
        to, marks = _step("LET", kind)  # no contraction: a word started at the letter before
        return to, marks | BACK
    if kind == "reset":
        return "START", HERE
    if kind in ("space", "white"):
        if state in ("SP1", "W1", "SPM", "WM"):
            return ("SPM" if kind == "space" else "WM"), 0
        return ("SP1" if kind == "space" else "W1"), HERE
    to = "LET" if kind in LETTERS else {"number": "NUM", "apostrophe": "APO", "other": "OTH"}[kind]
    attached = "OTH" if to == "APO" else to  # behind a space an apostrophe starts no contraction
    if state == "SP1":
        return attached, 0
    if state == "SPM":
        return attached, BACK
    if state == "WM":
        return to, BACK | HERE
    if state == "APO" and kind in ("single", "r", "v", "l"):
        return {"single": "CON", "r": "AR", "v": "AV", "l": "AL"}[kind], 0
    if state in ("OTH", "APO") and kind in ("apostrophe", "other"):
        return "OTH", 0
    if state == to and state in ("LET", "NUM"):
        return to, 0
    return to, HERE


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    step = [[_step(s, c) for c in CLASSES] for s in STATES]
    return np.array([[STATES.index(x[0]) for x in row] for row in step], np.intp), np.array([[x[1] for x in row] for row in step], np.uint8)


NEXT, MARKS = _splitter()
N_CLASSES = len(CLASSES)
#: The states that can hold after one character of a class, and for each entry state its place among them.
IMAGES = [np.unique(NEXT[:, c]) for c in range(N_CLASSES)]
WIDTH = max(map(len, IMAGES))
SLOTS = np.array([[im[min(k, len(im) - 1)] for k in range(WIDTH)] for im in IMAGES], np.intp)
PLACE = np.array([[int(np.searchsorted(IMAGES[c], NEXT[s, c])) for s in range(len(STATES))] for c in range(N_CLASSES)], np.intp)

_TABLE: list[np.ndarray] = []


def class_table() -> np.ndarray:
    if not _TABLE:
        table = np.full(0x110000, CLASSES.index("other"), np.uint8)
        kinds = {"L": CLASSES.index("letter"), "N": CLASSES.index("number")}
        for i in range(0x110000):
            k = kinds.get(unicodedata.category(chr(i))[0])
            if k is not None:
                table[i] = k
        table[WHITE_SPACE] = CLASSES.index("white")
        table[32] = CLASSES.index("space")
        table[39] = CLASSES.index("apostrophe")
        for c in "stmd":
            table[ord(c)] = CLASSES.index("single")
        for c in "rvle":
            table[ord(c)] = CLASSES.index(c)
        _TABLE.append(table)
    return _TABLE[0]


def scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of (chunks, states) maps: row i maps the first chunk's entry to chunk i's exit."""
    out, d = maps.copy(), 1
    while d < len(out):
        out[d:] = np.take_along_axis(out[d:], out[:-d].copy(), axis=1)
        d *= 2
    return out


def piece_starts(kinds: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Positions at which a piece starts; kinds are classes, a reset before every text (marked as a piece of its own)."""
    n = len(kinds)
    k = -(-n // chunk)
    padded = np.zeros(k * chunk, np.uint8)  # class 0: reset
    padded[:n] = kinds
    by_step = np.ascontiguousarray(padded.reshape(k, chunk).T).astype(np.intp)
    seen = np.empty((chunk, WIDTH, k), np.uint8)
    flat = NEXT.ravel()
    now = np.ascontiguousarray(SLOTS[by_step[0]].T)
    seen[0] = now
    for j in range(1, chunk):
        now = flat[now * N_CLASSES + by_step[j]]
        seen[j] = now
    place = PLACE[by_step[0]]  # (chunks, entry states)
    maps = np.take_along_axis(np.ascontiguousarray(now.T), place, axis=1)
    entry = np.zeros(k, np.intp)
    entry[1:] = scan(maps)[:-1, 0]
    slot = place[np.arange(k), entry]
    states = np.take_along_axis(seen, slot[None, None, :], axis=1)[:, 0, :]
    before = np.empty((chunk, k), np.intp)
    before[0], before[1:] = entry, states[:-1]
    marks = MARKS.ravel()[before * N_CLASSES + by_step].T.ravel()[:n]
    starts = (marks & HERE).astype(bool)
    starts[:-1] |= (marks[1:] & BACK).astype(bool)
    return np.flatnonzero(starts)


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """The counting transducer of one vocabulary."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.special = [t["content"] for t in spec["added_tokens"]]
        added = set(self.special)
        self.ids = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        self.rank: dict[int, int] = {}  # left << 32 | right
        self.made: dict[int, tuple[int, int, int]] = {}  # token: rank, left, right
        for r, (x, y) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            x, y = as_bytes(x), as_bytes(y)
            self.rank[self.ids[x] << 32 | self.ids[y]] = r
            self.made[self.ids[x + y]] = (r, self.ids[x], self.ids[y])
        self.left_parts = {x for _, x, _ in self.made.values()}
        self.rights, self.lefts, self.classes, self.class_no, self.class_edges = {}, {}, {}, {}, []
        self.starts = {t[:k] for t in self.ids for k in range(len(t) + 1)}
        self.memo: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        first = (b"", ((0, -1, 0),))
        self.states, self.numbers, self.moves = [first], {first: 0}, {}

    def right_edge(self, t: int) -> tuple[tuple[int, int], ...]:
        """The symbols at a token's right end while it is merged, each with the rank that ends it."""
        known = self.rights.get(t)
        if known is None:
            made = self.made.get(t)
            known = ((t, NEVER),) if made is None else (*self.right_edge(made[2])[:-1], (made[2], made[0]), (t, NEVER))
            self.rights[t] = known
        return known

    def left_edge(self, t: int) -> tuple[tuple[int, int], ...]:
        known = self.lefts.get(t)
        if known is None:
            made = self.made.get(t)
            known = ((t, NEVER),) if made is None else (*self.left_edge(made[1])[:-1], (made[1], made[0]), (t, NEVER))
            self.lefts[t] = known
        return known

    def fits(self, right: tuple[tuple[int, int], ...], t: int) -> bool:
        """Whether t can follow a token of this right edge: no merge across the joint comes first on the way up."""
        left, rank = self.left_edge(t), self.rank
        i = j = 0
        while True:
            a, until_a = right[i]
            b, until_b = left[j]
            joint = rank.get(a << 32 | b, NEVER)
            if joint < until_a and joint <= until_b:
                return False
            if until_a <= until_b:
                if until_a == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def edge_class(self, t: int) -> int:
        """Tokens of one class behave alike before any next token: symbols that merge with nothing to their right are one."""
        known = self.classes.get(t)
        if known is None:
            edge = tuple((s if s in self.left_parts else -1, r) for s, r in self.right_edge(t))
            known = self.class_no.setdefault(edge, len(self.class_no))
            if known == len(self.class_edges):
                self.class_edges.append(edge)
            self.classes[t] = known
        return known

    def build(self, number: int, byte: int) -> tuple[int, int]:
        suffix, seen = self.states[number]
        grown = suffix + bytes([byte])
        token = count = None
        for k, edge, rel in seen:  # the longest token first
            t = self.ids.get(grown[k:])
            if t is not None and (edge < 0 or self.fits(self.class_edges[edge], t)):
                token, count = t, rel + 1
                break
        if token is None:
            raise ValueError("the vocabulary has an encoding that doesn't extend byte by byte")
        starts = self.starts
        kept = [(k, e, r - count) for k, e, r in seen if grown[k:] in starts]
        off = kept[0][0] if kept else len(grown)
        state = (grown[off:], (*((k - off, e, r) for k, e, r in kept), (len(grown) - off, self.edge_class(token), 0)))
        to = self.numbers.get(state)
        if to is None:
            to = self.numbers[state] = len(self.states)
            self.states.append(state)
        self.moves[number << 8 | byte] = to, count
        return to, count

    def walk(self, at: int, data: bytes) -> tuple[int, int]:
        """(exit state, tokens) of bytes read from an entry state."""
        n, moves = 0, self.moves
        for b in data:
            move = moves.get(at << 8 | b) or self.build(at, b)
            at = move[0]
            n += move[1]
        return at, n

    def through(self, node: tuple, at: int) -> tuple[int, int]:
        """An entry of a chunk's map (its map, its bytes) or of a composed one (its map, the left one, the right one)."""
        got = node[0].get(at)
        if got is None:
            if len(node) == 2:
                got = self.walk(at, node[1])
            else:
                middle, before = self.through(node[1], at)
                to, after = self.through(node[2], middle)
                got = to, before + after
            node[0][at] = got
        return got

    def composed(self, at: int, data: bytes, chunk: int = CHUNK) -> tuple[int, int]:
        """As walk, through the composed maps of chunks."""
        known: dict = {}
        level = [known.setdefault(c, ({}, c)) for c in (data[i : i + chunk] for i in range(0, len(data), chunk))]
        while len(level) > 1:
            pairs = [known.setdefault((id(a), id(b)), ({}, a, b)) for a, b in zip(level[::2], level[1::2])]
            level = pairs + level[2 * len(pairs) :]
        return self.through(level[0], at)

    def count_piece(self, piece: str) -> int:
        data = piece.encode("utf-8", "surrogatepass")
        if len(data) <= LONG_PIECE:
            n = self.walk(0, data)[1]
            if len(self.states) > STATES_MAX:
                self.reset()
            return n
        n = at = 0
        for i in range(0, len(data), SEGMENT):
            at, more = self.composed(at, data[i : i + SEGMENT])
            n += more
            if len(self.states) > STATES_MAX:
                state = self.states[at]
                self.reset()
                at = self.numbers.setdefault(state, len(self.states))
                if at == len(self.states):
                    self.states.append(state)
        return n

    def count_pieces(self, big: str, bounds: list[int]) -> list[int]:
        memo, count_piece = self.memo, self.count_piece
        if len(memo) > MEMO_MAX:
            memo.clear()
        out = []
        for a, b in zip(bounds, bounds[1:]):
            piece = big[a:b]
            n = memo.get(piece)
            if n is None:
                n = count_piece(piece)
                if b - a <= MEMO_PIECE:
                    memo[piece] = n
            out.append(n)
        return out

    def count_long(self, text: str, window: int) -> int:
        """Tokens of a text without special strings, window by window."""
        n, at, size = 0, 0, window
        while at < len(text):
            big = "\n" + text[at : at + size]  # the line feed stands for the reset
            kinds = class_table()[np.frombuffer(big.encode("utf-32-le", "surrogatepass"), np.uint32)]
            kinds[0] = 0
            bounds = piece_starts(kinds)[1:].tolist()
            if at + size >= len(text):
                bounds.append(len(big))
            elif len(bounds) <= SPARE:  # a piece as long as the window: take more
                size *= 2
                continue
            else:
                bounds = bounds[:-SPARE]
            if len(bounds) > 1 or at + size >= len(text):
                n += sum(self.count_pieces(big, bounds))
                at += bounds[-1] - 1
                size = window
            else:
                size *= 2
        return n

    def count_texts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        pieces, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            parts = [t or ""]
            for s in self.special:
                if t and s in t:
                    parts = [y for x in parts for y in x.split(s)]
            extra[i] = len(parts) - 1
            for k, part in enumerate(parts):
                if len(part) > BATCH_CHARS:
                    extra[i] += self.count_long(part, BATCH_CHARS)
                    parts[k] = ""
            pieces += parts
            owner += [i] * len(parts)
        big = "\n" + "\n".join(pieces) if pieces else ""
        if not big:
            return extra
        codes = np.frombuffer(big.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = class_table()[codes]
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        resets = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        kinds[resets] = 0
        starts = piece_starts(kinds)
        counts = np.array(self.count_pieces(big, [*starts.tolist(), len(big)]), np.int64)
        counts[np.searchsorted(starts, resets)] = 0
        per_piece = np.add.reduceat(counts, np.searchsorted(starts, resets))
        return extra + np.bincount(owner, per_piece, len(texts)).astype(np.int64)


_COUNTERS: dict[int, Counter] = {}


def counter_of(raw: bytes) -> Counter:
    key = hash(raw)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(raw)
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """One row for each row of docs (doc_id, text): n_bytes, n_tokens, over_limit. vocabulary: a file of the driver's."""
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file: a fixed size

    def run(batches):
        counter = counter_of(shared.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            size = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
            at = 0
            while at < len(size):
                upto = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), BATCH_CHARS)) + at)
                n = counter.count_texts(texts.slice(at, upto - at).to_pylist())
                yield pa.RecordBatch.from_arrays([ids.slice(at, upto - at), pa.array(size[at:upto]), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
                at = upto

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op4_transducer_tokens(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    return count_tokens(load(spark, sf_dir, "documents"), vocabulary)
