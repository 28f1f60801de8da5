"""SentencePiece lattices: sampled encodings without replacement, and decoding.

A text's segmentations are the paths of its lattice of vocabulary pieces (a character that is no piece goes by its
bytes), a path's probability being the product of its pieces'. Gumbel top-k: of all paths' log-probabilities, each
disturbed by its own Gumbel number, the `k` greatest are an ordered sample of k distinct segmentations without replacement.
They are found from the top down, as in A* with the exact mass behind each node as its bound: the best disturbed value of a set of
paths is a Gumbel number at the set's log-mass, cut off at the value of the set that it was split from; the set with the greatest
value is opened, a path is drawn in it, and what branches off that path becomes a set again. The (k + 1)-th value gives
each sample's inclusion score.

Random numbers are hashes of the row's key, the sample and the place in the text, so a row's samples are the same however the
table is partitioned. No piece spans two bytes that never meet inside a piece, so a text is cut into units there, and every
distinct unit's lattice is built once.

The vocabulary is a BPE model's: its pieces have ranks, not probabilities, so a piece of rank r gets one in proportion
to 1 / (r + `OFFSET`), flattened by the exponent `ALPHA`.

Nulls: a null text and an empty one have one segmentation, without tokens; a null key seeds as -1. A text with fewer than k segmentations
gives all of them. Rows with equal keys and texts get equal samples. Tied disturbed values fall to the one found first. A very long text is sampled whole,
alone in its lattice. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common as C
from .neardup import GOLDEN, mix

ALPHA = 0.5
OFFSET = 100
#: Bytes whose distinct units share one lattice, and bytes sampled at once within them.
LATTICE_BYTES = 3 << 19
SAMPLED_BYTES = 1 << 19
#: Log-probabilities are summed in steps of 1 / GRAIN.
GRAIN = 2.0**36
SPACE = "▁"
SAMPLE_SCHEMA = "doc_id long, sample int, ids binary, log_prob double, log_inclusion double"

_vocabularies: dict[str, "Vocabulary"] = {}


class Vocabulary:
    """Pieces as bytes with log-probabilities, and a trie of them as a table of states and bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        by_rank = sorted(plain, key=lambda i: (-model.get_score(i), i))
        self.bytes_of = [b""] * n
        self.byte_id = np.zeros(256, np.int64)
        for i in range(n):
            if model.is_byte(i):
                self.byte_id[int(model.id_to_piece(i)[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(model.id_to_piece(i)[3:5], 16)])
        weight = 1.0 / (np.arange(len(plain)) + 1 + OFFSET)
        low = 1.0 / (len(plain) + 1 + OFFSET)
        total = weight.sum() + 256 * low
        self.log = np.zeros(n)
        self.byte_log = ALPHA * np.log(low / total)
        pairs = np.zeros(65536, bool)
        children: dict[int, int] = {}
        terminal = [-1]
        for rank, i in enumerate(by_rank):
            piece = model.id_to_piece(i).replace(SPACE, " ").encode()
            self.bytes_of[i] = piece
            self.log[i] = ALPHA * np.log(weight[rank] / total)
            state = 0
            for k, byte in enumerate(piece):
                if k:
                    pairs[piece[k - 1] << 8 | byte] = True
                at = state << 8 | byte
                if at not in children:
                    children[at] = len(terminal)
                    terminal.append(-1)
                state = children[at]
            terminal[state] = i
        # bytes of one character always hold together
        pairs |= np.add.outer(np.zeros(256), np.arange(256) & 0xC0).reshape(-1) == 0x80
        self.pairs = pairs
        self.terminal = np.array(terminal, np.int64)
        keys, values = np.array(list(children), np.int64), np.array(list(children.values()), np.int64)
        inner = np.unique(keys >> 8)  # states with children have a row of the table each, the others share an empty one
        self.row = np.full(len(terminal), len(inner), np.int64)
        self.row[inner] = np.arange(len(inner))
        self.table = np.full((len(inner) + 1) * 256, -1, np.int32)
        self.table[self.row[keys >> 8] * 256 + (keys & 0xFF)] = values
        self.sizes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.pool = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts as the model sees them: a space in front, if not empty, and the space's sign as a space."""
    whole = pc.fill_null(texts.cast(pa.large_string()), "")
    if pc.any(pc.match_substring(whole, SPACE)).as_py():
        whole = pc.replace_substring(whole, SPACE, " ")
    front = pc.if_else(pc.equal(whole, ""), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    return C.utf8(pc.binary_join_element_wise(front, whole, pa.scalar("", pa.large_string())))


class Lattice:
    """The lattices of some units, one after the other; a unit of n bytes has n + 1 nodes."""

    def __init__(self, vocab: Vocabulary, units: pa.Array):
        data, offsets = C.utf8(units)
        sizes = np.diff(offsets)
        self.first_node = offsets[:-1] + np.arange(len(sizes))
        self.last_node = self.first_node + sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        stop = offsets[1:][owner]
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        width = np.diff(np.append(starts, len(data)))
        state = vocab.table[data[starts]].astype(np.int64)  # the root's row is the first
        origin = np.arange(len(starts))
        single = np.zeros(len(starts), bool)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        depth = 1
        while True:
            alive = state >= 0
            origin, state = origin[alive], state[alive]
            if not len(origin):
                break
            ends = vocab.terminal[state] >= 0
            found.append((origin[ends], np.full(int(ends.sum()), depth), vocab.terminal[state[ends]]))
            single[origin[ends][width[origin[ends]] == depth]] = True
            at = starts[origin] + depth
            inside = at < stop[starts[origin]]
            origin, state, at = origin[inside], state[inside], at[inside]
            state = vocab.table[vocab.row[state] * 256 + data[at]].astype(np.int64)
            depth += 1
        spelt = np.flatnonzero(~single)  # characters that are no piece
        found.append((spelt, width[spelt], np.full(len(spelt), -1)))
        found.reverse()  # a node's longest piece, mostly its likeliest, comes first
        origin, length, piece = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
        source = starts[origin] + owner[starts[origin]] if len(starts) else np.zeros(0, np.int64)
        del found, spelt, single, state
        order = np.argsort(source, kind="stable")
        self.source, self.piece, self.length = source[order], piece[order].astype(np.int32), length[order].astype(np.int32)
        del source, piece, length, origin, order
        self.target = self.source + self.length
        n_nodes = int(self.last_node[-1]) + 1 if len(sizes) else 0
        self.count = np.bincount(self.source, minlength=n_nodes + 1)
        self.first = np.cumsum(self.count) - self.count
        score = np.where(self.piece >= 0, vocab.log[self.piece], vocab.byte_log * self.length)
        node_owner = np.repeat(np.arange(len(sizes)), sizes + 1)
        left = self.last_node[node_owner] - np.arange(n_nodes)  # bytes from a node to its unit's end
        behind = np.zeros(n_nodes)
        nodes = np.flatnonzero(self.count[:n_nodes])
        nodes = nodes[np.argsort(left[nodes], kind="stable")]
        cuts = np.append(np.flatnonzero(np.diff(left[nodes], prepend=-1)), len(nodes))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            some = nodes[a:b]
            n = self.count[some]
            arcs = C.ragged(self.first[some], n)
            value = score[arcs] + behind[self.target[arcs]]
            heads = np.cumsum(n) - n
            top = np.maximum.reduceat(value, heads)
            behind[some] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, n)), heads))
        self.log = np.minimum(score + behind[self.target] - behind[self.source], 0.0)
        self.log[self.count[self.source] == 1] = 0.0
        p = np.exp(self.log)
        heads = self.first[np.flatnonzero(self.count)]
        n = self.count[self.source[heads]] if len(heads) else np.zeros(0, np.int64)
        run = np.cumsum(p)
        self.cum = run - np.repeat(run[heads] - p[heads], n) if len(heads) else run
        self.cum[heads + n - 1] = 1.0
        if len(heads):
            top = np.maximum.reduceat(p, heads)
            is_top = p == np.repeat(top, n)
            others = np.add.reduceat(np.where(is_top, 0.0, p), heads) + np.maximum(np.add.reduceat(is_top, heads, dtype=np.int64) - 1, 0) * top
            rest = np.where(is_top, np.repeat(others, n), 1.0 - p)
        else:
            rest = p
        with np.errstate(divide="ignore"):
            self.rest = np.log(np.maximum(rest, 0.0))
        self.rest[self.count[self.source] == 1] = -np.inf


def uniform(seed: np.ndarray, salt: int) -> np.ndarray:
    """Numbers between 0 and 1, both excluded."""
    h = mix(seed + np.uint64((salt + 1) * int(GOLDEN) % 2**64))
    return ((h >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def cut_gumbel(mass: np.ndarray, cap: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel numbers at `mass`, given that they are below `cap`; -inf for an empty set."""
    with np.errstate(over="ignore", invalid="ignore"):
        value = mass - np.log(np.exp(mass - cap) - np.log(u))
    return np.where(np.isneginf(mass), -np.inf, value)


def draw(lat: Lattice, nodes: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A path from each node to its unit's end, by the arcs' probabilities: arcs of all, and how many each has."""
    n = len(nodes)
    taken, steps = [], np.zeros(n, np.int64)
    who = np.flatnonzero(nodes < ends)
    node = nodes[who]
    step = 0
    while len(who):
        arc = lat.first[node].copy()
        many = np.flatnonzero(lat.count[node] > 1)
        if len(many):
            u = uniform(seeds[who[many]], step)
            while len(many):  # cum is 1 at a node's last arc
                beyond = u >= lat.cum[arc[many]]
                many, u = many[beyond], u[beyond]
                arc[many] += 1
        taken.append((who, arc))
        steps[who] += 1
        node = lat.target[arc]
        going = node < ends[who]
        who, node = who[going], node[going]
        step += 1
    heads = np.cumsum(steps) - steps
    out = np.zeros(int(steps.sum()), np.int64)
    for k, (who, arc) in enumerate(taken):
        out[heads[who] + k] = arc
    return out, steps


class Paths:
    """For some documents, a drawn path each, and the mass that branches off it at or after its first own token."""

    def __init__(self, lat: Lattice, docs: np.ndarray, arcs: np.ndarray, counts: np.ndarray, own: np.ndarray):
        self.docs, self.arcs, self.ends = docs, arcs, np.concatenate([[0], np.cumsum(counts)])
        self.own = own  # tokens before this one belong to the set that it was split from
        # Sums of whole numbers are exact, so a document's don't depend on those before it.
        total = np.concatenate([[0], np.cumsum(np.rint(lat.log[arcs] * GRAIN).astype(np.int64))])
        self.log_prob = (total[self.ends[1:]] - total[self.ends[:-1]]) / GRAIN
        before = (total[:-1] - np.repeat(total[self.ends[:-1]], counts)) / GRAIN
        with np.errstate(under="ignore"):
            self.off = before + lat.rest[arcs]  # log-mass that leaves the path at each token
        place = np.arange(len(arcs)) - np.repeat(self.ends[:-1], counts)
        self.before = before
        self.off[place < np.repeat(own, counts)] = -np.inf
        self.gone: dict[int, set[int]] = {}  # arcs already split off, by token

    def mass(self, i: np.ndarray) -> np.ndarray:
        out = np.full(len(i), -np.inf)
        for k, d in enumerate(i.tolist()):
            off = self.off[self.ends[d] : self.ends[d + 1]]
            if len(off) and np.isfinite(top := off.max()):
                out[k] = top + np.log(np.exp(off - top).sum())
        return out


def sample_texts(vocab: Vocabulary, lat: Lattice, codes: np.ndarray, of_doc: np.ndarray, keys: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Samples 1 to k: (number, documents, arcs, counts of arcs, log-probabilities, scores); scores are final values less the threshold's."""
    n_docs = len(of_doc) - 1
    seed = mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x5EED))
    units = np.diff(of_doc)
    place = np.arange(len(codes)) - np.repeat(of_doc[:-1], units)
    doc = np.repeat(np.arange(n_docs), units)

    def unit_seeds(which: np.ndarray, sample: int) -> np.ndarray:
        return mix(seed[doc[which]] + np.uint64(sample * 0xD1B54A32D192ED03 % 2**64) + place[which].astype(np.uint64) * GOLDEN)

    everything = np.arange(len(codes))
    arcs, steps = draw(lat, lat.first_node[codes], lat.last_node[codes], unit_seeds(everything, 0))
    counts = C.sums(steps, of_doc)
    unit_ends = np.cumsum(steps)  # tokens up to each unit's end, by occurrence
    first = Paths(lat, np.arange(n_docs), arcs, counts, np.zeros(n_docs, np.int64))
    value = -np.log(-np.log(uniform(seed, 1)))
    sets: list[tuple[Paths, np.ndarray, np.ndarray]] = []  # paths, occurrence of each token, value of the best path off them by document
    occurrence = np.repeat(everything, steps)
    samples = [(first, value)]
    sets.append((first, occurrence, cut_gumbel(first.mass(np.arange(n_docs)), value, uniform(seed, 2))))
    for m in range(1, k):
        best = np.stack([s[2] for s in sets])
        which = best.argmax(axis=0)
        value = best.max(axis=0)
        chosen = np.flatnonzero(np.isfinite(value))
        if not len(chosen):
            break
        u, v = uniform(seed, 10 * m + 3), uniform(seed, 10 * m + 4)
        prefix, rest_occ, rest_node, rest_end, new_docs = [], [], [], [], []
        for d in chosen.tolist():
            paths, occ, _ = sets[which[d]]
            i = int(np.searchsorted(paths.docs, d))
            a, b = paths.ends[i], paths.ends[i + 1]
            off = paths.off[a:b]
            run = np.cumsum(np.exp(off - off.max()))
            j = int(np.searchsorted(run, u[d] * run[-1]))
            arc = paths.arcs[a + j]
            node = lat.source[arc]
            gone = paths.gone.setdefault(a + j, {int(arc)})
            open_ = np.array([x for x in range(lat.first[node], lat.first[node] + lat.count[node]) if x not in gone])
            p = np.exp(lat.log[open_])
            pick = int(open_[min(int(np.searchsorted(np.cumsum(p), v[d] * p.sum())), len(open_) - 1)])
            gone.add(pick)
            left = p[open_ != pick].sum()
            paths.off[a + j] = paths.before[a + j] + np.log(left) if left > 0 else -np.inf
            prefix.append(np.append(paths.arcs[a : a + j], pick))
            o = occ[a + j]
            rest_occ.append(np.arange(o, of_doc[d + 1]))
            nodes = lat.first_node[codes[o : of_doc[d + 1]]].copy()
            nodes[0] = lat.target[pick]
            rest_node.append(nodes)
            rest_end.append(lat.last_node[codes[o : of_doc[d + 1]]])
            new_docs.append(np.append(occ[a : a + j], o))
        tails = np.concatenate(rest_occ)
        arcs, steps = draw(lat, np.concatenate(rest_node), np.concatenate(rest_end), unit_seeds(tails, m))
        tail_units = np.array([len(r) for r in rest_occ])
        heads = np.cumsum(tail_units) - tail_units
        tail_counts = np.add.reduceat(steps, heads)
        tail_ends = np.cumsum(tail_counts)
        tail_occ = np.repeat(tails, steps)
        parts, occs = [], []
        for i, pre in enumerate(prefix):
            a, b = tail_ends[i] - tail_counts[i], tail_ends[i]
            parts += [pre, arcs[a:b]]
            occs += [new_docs[i], tail_occ[a:b]]
        own = np.array([len(pre) for pre in prefix])
        made = Paths(lat, chosen, np.concatenate(parts), own + tail_counts, own)
        for s, (paths, _, worth) in enumerate(sets):  # the sets that were split: what is left of them is below the value taken
            hit = chosen[which[chosen] == s]
            if len(hit):
                worth[hit] = cut_gumbel(paths.mass(np.searchsorted(paths.docs, hit)), value[hit], uniform(seed, 10 * m + 5)[hit])
        fresh = np.full(n_docs, -np.inf)
        fresh[chosen] = cut_gumbel(made.mass(np.arange(len(chosen))), value[chosen], uniform(seed, 10 * m + 6)[chosen])
        samples.append((made, value[chosen]))
        sets.append((made, np.concatenate(occs), fresh))
    threshold = np.stack([s[2] for s in sets]).max(axis=0)
    for m, (paths, _) in enumerate(samples):
        yield m + 1, paths.docs, paths.arcs, np.diff(paths.ends), paths.log_prob, paths.log_prob - threshold[paths.docs]


def inclusion(x: np.ndarray) -> np.ndarray:
    """log(1 - exp(-exp(x))): the log-probability that a path x above the threshold is in the sample."""
    with np.errstate(over="ignore", divide="ignore"):
        return np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.minimum(x, 50)))))


def arc_ids(vocab: Vocabulary, lat: Lattice, units: tuple[np.ndarray, np.ndarray], arcs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of paths, and how many each has; an arc without a piece stands for the ids of its bytes."""
    piece = lat.piece[arcs]
    spelt = np.flatnonzero(piece < 0)
    if not len(spelt):
        return piece, counts
    many = np.ones(len(arcs), np.int64)
    many[spelt] = lat.length[arcs[spelt]]
    ids = np.repeat(piece, many)
    data, owner = units
    source = lat.source[arcs[spelt]]
    at = source - owner[source]  # nodes to bytes: a unit has one node more than it has bytes
    ids[ids < 0] = vocab.byte_id[data[C.ragged(at, many[spelt])]]
    return ids, C.sums(many, np.concatenate([[0], np.cumsum(counts)]))


Batches = Iterator[pa.RecordBatch]


def encode_batches(batches: Batches, model: str, k: int) -> Batches:
    """Batches of doc_id and text to batches of `SAMPLE_SCHEMA`."""
    vocab = vocabulary(model)
    for batch in batches:
        for piece in C.pieces(batch, "text", LATTICE_BYTES):
            data, offsets = normalised(piece.column("text"))
            first = np.zeros(len(data) + 1, bool)
            first[offsets] = True
            if len(data):
                first[1:-1] |= ~vocab.pairs[data[:-1].astype(np.uint16) << 8 | data[1:]]
            starts = np.flatnonzero(first[:-1])
            cut = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
            codes, distinct = C.coded(cut)
            of_doc = np.searchsorted(starts, offsets)
            lat = Lattice(vocab, distinct)
            spelling, ends = C.utf8(distinct)
            owner = np.repeat(np.arange(len(distinct)), np.diff(ends) + 1)
            keys = np.asarray(piece.column("doc_id").fill_null(-1))
            sub = 0
            while sub < len(piece):  # paths are drawn for a stretch of documents at a time
                to = max(sub + 1, int(np.searchsorted(offsets, offsets[sub] + SAMPLED_BYTES, side="right")) - 1)
                lo, hi = of_doc[sub], of_doc[to]
                for m, who, arcs, counts, log_prob, above in sample_texts(vocab, lat, codes[lo:hi], of_doc[sub : to + 1] - lo, keys[sub:to], k):
                    ids, n = arc_ids(vocab, lat, (spelling, owner), arcs, counts)
                    bounds = np.concatenate([[0], np.cumsum(n)]) * 4
                    raw = pa.Array.from_buffers(pa.binary(), len(who), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                    yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(pa.array(who + sub)), pa.array(np.full(len(who), m), pa.int32()), raw, pa.array(log_prob), pa.array(inclusion(above))], ["doc_id", "sample", "ids", "log_prob", "log_inclusion"])
                sub = to
            del lat, codes, distinct, cut, data, first, starts, owner, spelling
            C.trim()


def decode_batches(batches: Batches, model: str) -> Batches:
    """Batches with a column ids to batches with a column decoded besides."""
    vocab = vocabulary(model)
    for batch in batches:
        for piece in C.pieces(batch, "ids"):
            data, offsets = C.utf8(piece.column("ids"))
            ids = np.frombuffer(data.tobytes(), "<u4").astype(np.int64)
            size = vocab.sizes[ids]
            text = vocab.pool[C.ragged(vocab.starts[ids], size)]
            ends = np.concatenate([[0], np.cumsum(size)])[offsets // 4]
            keep = np.ones(len(text), bool)
            keep[ends[:-1][ends[1:] > ends[:-1]]] = False  # the space in front
            ends = ends - np.concatenate([[0], np.cumsum(ends[1:] > ends[:-1])])
            out = pa.Array.from_buffers(pa.large_string(), len(piece), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(text[keep]))])
            yield pa.RecordBatch.from_arrays([*piece.columns, out.cast(pa.string())], [*piece.schema.names, "decoded"])


def encode_samples(docs: DataFrame, model: str, k: int = 2) -> DataFrame:
    """doc_id, sample (1 to k, best first), ids (little-endian unsigned 32-bit), log_prob and log_inclusion."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda batches: encode_batches(batches, model, k), SAMPLE_SCHEMA)


def decode(rows: DataFrame, model: str) -> DataFrame:
    """`rows` with `decoded`, the text of their ids: pieces and bytes joined, without the space in front."""
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in rows.dtypes), "decoded string"])
    return rows.mapInArrow(lambda batches: decode_batches(batches, model), schema)


def digest_batches(batches: Batches) -> Batches:
    """Figures of encoded and decoded batches."""
    for batch in batches:
        sums = [pa.array([zlib.crc32(x.as_buffer()) for x in batch.column(c)], pa.int64()) for c in ("ids", "decoded")]
        n = pc.divide(pc.binary_length(batch.column("ids")), 4).cast(pa.int64())
        names = ["doc_id", "sample", "n_tokens", "ids_crc32", "log_prob", "log_inclusion", "text_crc32"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sample"), n, sums[0], batch.column("log_prob"), batch.column("log_inclusion"), sums[1]], names)


def digests(docs: DataFrame, k: int = 2) -> DataFrame:
    """Every sample's length, crc32 of its ids and of the text decoded from them, and scores. The ids stay in the worker."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, sample int, n_tokens long, ids_crc32 long, log_prob double, log_inclusion double, text_crc32 long"
    return rows.mapInArrow(lambda batches: digest_batches(decode_batches(encode_batches(batches, model, k), model)), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(C.table(spark, sf_dir, "documents"))
