"""Lossless WebP (VP8L) in numpy: a decoder of every feature of the format, and an encoder.

The decoder reads prefix codes (simple and normal, with meta prefix groups), back-references, colour-cache codes, and
inverts the predictor, cross-colour, subtract-green and palette transforms. Images with one group of codes and no
colour cache are decoded speculatively: for every bit position of a stretch the pixel that would start there and the
position after it are looked up at once, and the true pixels are those that a walk from the start visits.

Pixels are uint32 ARGB values of shape (height, width).
"""

from __future__ import annotations

import heapq

import numpy as np

# Fixed values of the format: the order of code-length codes, alphabet sizes without the cache, the cache's multiplier.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
ALPHABETS = (280, 256, 256, 256, 40)
CACHE_MULTIPLIER = 0x1E35A7BD
#: Distance codes 1 to 120 name neighbours by their distance, then by how far they stand to the side.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
STRETCH = 1 << 20
REVERSED = sum(((np.arange(1 << 15) >> k) & 1) << (14 - k) for k in range(15)).tolist()


class Bits:
    """Bits of a byte string, least significant first; beyond the end they are 0."""

    def __init__(self, data: bytes):
        self.data, self.at = data + b"\0" * 16, 0
        self.codes: dict[tuple, Code] = {}  # those of this file, by their lengths

    def read(self, n: int) -> int:
        i = self.at >> 3
        out = (int.from_bytes(self.data[i : i + 8], "little") >> (self.at & 7)) & ((1 << n) - 1)
        self.at += n
        return out


class Code:
    """A canonical prefix code as tables indexed by the next `width` bits."""

    def __init__(self, used: tuple[tuple[int, int], ...]):
        """used: (length, symbol) of the symbols that occur."""
        self.pairs: list[tuple[int, int]] = []
        if len(used) < 2:
            self.width, self.symbols, self.sizes = 0, np.array([used[0][1] if used else 0], np.int32), np.zeros(1, np.int32)
        else:
            self.width = max(n for n, _ in used)
            self.symbols, self.sizes = np.zeros(1 << self.width, np.int32), np.zeros(1 << self.width, np.int32)
            for symbol, (code, n) in canonical(used).items():
                self.symbols[code :: 1 << n] = symbol
                self.sizes[code :: 1 << n] = n
        self.mask = (1 << self.width) - 1

    def read(self, bits: Bits) -> int:
        if not self.pairs:
            self.pairs = list(zip(self.symbols.tolist(), self.sizes.tolist(), strict=True))
        at = bits.at
        symbol, size = self.pairs[(int.from_bytes(bits.data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7)) & self.mask]
        bits.at = at + size
        return symbol


def code_of(bits: Bits, lengths: list[int]) -> Code:
    used = tuple((n, s) for s, n in enumerate(lengths) if n)
    code = bits.codes.get(used)
    if code is None:
        code = bits.codes[used] = Code(used)
    return code


def canonical(used) -> dict[int, tuple[int, int]]:
    """Symbol -> (code with its bits reversed, length) for (length, symbol) pairs."""
    out, code, before = {}, 0, 0
    for n, symbol in sorted(used):
        code <<= n - before
        before = n
        out[symbol] = (REVERSED[code] >> (15 - n), n)
        code += 1
    return out


def read_code(bits: Bits, size: int) -> Code:
    lengths = [0] * size
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        for n in [8 if wide else 1, 8][: two + 1]:
            lengths[bits.read(n)] = 1
        return code_of(bits, lengths)
    meta = [0] * 19
    for k in LENGTH_ORDER[: 4 + bits.read(4)]:
        meta[k] = bits.read(3)
    code = code_of(bits, meta)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, last, here, data = 0, 8, bits.at, bits.data
    table, mask = list(zip(code.symbols.tolist(), code.sizes.tolist(), strict=True)), code.mask
    while at < size and left:
        left -= 1
        ahead = int.from_bytes(data[here >> 3 : (here >> 3) + 5], "little") >> (here & 7)
        k, n = table[ahead & mask]
        here += n
        if k < 16:
            lengths[at] = k
            at += 1
            last = k or last
            continue
        least, more = ((3, 2), (3, 3), (11, 7))[k - 16]
        n, here = least + (ahead >> n & (1 << more) - 1), here + more
        if at + n > size:
            raise ValueError("code lengths run over the alphabet")
        if k == 16:
            lengths[at : at + n] = [last] * n
        at += n
    bits.at = here
    return code_of(bits, lengths)


def prefixed(bits: Bits, k: int) -> int:
    """The value of a length or distance prefix with its extra bits."""
    if k < 4:
        return k + 1
    extra = (k - 2) >> 1
    return ((2 + (k & 1)) << extra) + bits.read(extra) + 1


def distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as flat ARGB."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    group_of, block, across = None, 0, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = -(-width >> block)
        meta = read_image(bits, across, -(-height >> block), False)
        group_of = ((meta >> 8) & 0xFFFF).astype(np.int64)
    groups = []
    for _ in range(int(group_of.max()) + 1 if group_of is not None else 1):
        groups.append([read_code(bits, n + ((1 << cache_bits) if cache_bits and not k else 0)) for k, n in enumerate(ALPHABETS)])
    if group_of is None and not cache_bits:
        return _fast(bits, width, height, groups[0])
    return _slow(bits, width, height, groups, group_of, block, across, cache_bits)


def _slow(bits: Bits, width: int, height: int, groups: list, group_of, block: int, across: int, cache_bits: int) -> np.ndarray:
    """Pixel by pixel; handles everything."""
    n, out = width * height, []
    cache = [0] * (1 << cache_bits) if cache_bits else None
    seen = 0
    while len(out) < n:
        at = len(out)
        codes = groups[0 if group_of is None else int(group_of[((at // width) >> block) * across + ((at % width) >> block)])]
        s = codes[0].read(bits)
        if s < 256:
            red, blue, alpha = codes[1].read(bits), codes[2].read(bits), codes[3].read(bits)
            out.append(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < 280:
            length = prefixed(bits, s - 256)
            back = distance(prefixed(bits, codes[4].read(bits)), width)
            if back > at or at + length > n:
                raise ValueError("a back-reference leaves the image")
            for _ in range(length):
                out.append(out[-back])
        else:
            out.append(cache[s - 280])
        if bits.at > 8 * len(bits.data):
            raise ValueError("the data end too early")
        if cache is not None:
            for argb in out[seen:]:
                cache[((argb * CACHE_MULTIPLIER) & 0xFFFFFFFF) >> (32 - cache_bits)] = argb
            seen = len(out)
    return np.array(out, np.uint32)


def _fast(bits: Bits, width: int, height: int, codes: list[Code]) -> np.ndarray:
    """One group, no cache: looks up every bit position of a stretch, then walks."""
    n, done = width * height, 0
    green, red, blue, alpha, far = codes
    out = np.empty(n, np.uint32)
    if not any(c.width for c in codes[:4]) and int(green.symbols[0]) < 256:
        out[:] = int(alpha.symbols[0]) << 24 | int(red.symbols[0]) << 16 | int(green.symbols[0]) << 8 | int(blue.symbols[0])
        return out
    raw = np.frombuffer(bits.data, np.uint8)
    margin = 64
    while done < n:
        base = bits.at >> 3
        # A stretch is no longer than the pixels that are left can take.
        length = min(STRETCH, 60 * (n - done) + 64, 8 * (len(raw) - base))
        if length <= 0:
            raise ValueError("the data end too early")
        part = raw[base : base + (length + margin >> 3) + 4].astype(np.uint32)
        if len(part) < (length + margin >> 3) + 4:
            part = np.concatenate([part, np.zeros((length + margin >> 3) + 4 - len(part), np.uint32)])
        three = part[:-3] | part[1:-2] << 8 | part[2:-1] << 16
        window = ((three[:, None] >> np.arange(8, dtype=np.uint32)) & 0x7FFF).astype(np.int32).reshape(-1)
        here = np.arange(length, dtype=np.int32)
        g = window[:length] & green.mask
        step = here + green.sizes[g]
        for code in (red, blue, alpha):
            if code.width:
                step = step + code.sizes[window[step] & code.mask]
        if green.symbols.max() >= 256:
            step = np.where(green.symbols[g] < 256, step, -1)
        walk, p, found, copies, left = memoryview(np.ascontiguousarray(step)), bits.at - 8 * base, [], [], n - done
        add = found.append
        while p < length and left > 0:
            q = walk[p]
            if q >= 0:
                add(p)
                p = q
                left -= 1
                continue
            bits.at = 8 * base + p  # a back-reference
            count = prefixed(bits, green.read(bits) - 256)
            back = distance(prefixed(bits, far.read(bits)), width)
            copies.append((len(found), count, back))
            left -= count
            p = bits.at - 8 * base
        bits.at = 8 * base + p
        if left < 0:
            raise ValueError("a back-reference leaves the image")
        at = np.array(found, np.int32)
        k = window[at]
        value = green.symbols[k & green.mask].astype(np.uint32) << 8
        at = at + green.sizes[k & green.mask]
        for code, shift in ((red, 16), (blue, 0), (alpha, 24)):
            k = window[at] & code.mask
            value |= code.symbols[k].astype(np.uint32) << shift
            at = at + code.sizes[k]
        used = 0
        for upto, count, back in [*copies, (len(found), 0, 1)]:
            out[done : done + upto - used] = value[used:upto]
            done += upto - used
            used = upto
            if not count:
                continue
            if back > done:
                raise ValueError("a back-reference leaves the image")
            if back >= count:
                out[done : done + count] = out[done - back : done - back + count]
            else:
                out[done : done + count] = np.resize(out[done - back : done].copy(), count)
            done += count
    return out


def _channels(argb: np.ndarray) -> list[np.ndarray]:
    """Alpha, red, green, blue as int32."""
    return [((argb >> s) & 255).astype(np.int32) for s in (24, 16, 8, 0)]


def _merge(a, r, g, b) -> np.ndarray:
    return ((a & 255) << 24 | (r & 255) << 16 | (g & 255) << 8 | (b & 255)).astype(np.uint32)


def _spread(blocks: np.ndarray, bits: int, width: int, height: int) -> np.ndarray:
    return np.repeat(np.repeat(blocks, 1 << bits, 0)[:height], 1 << bits, 1)[:, :width]


def _signed(x: np.ndarray) -> np.ndarray:
    return (x & 255) - 256 * ((x & 255) > 127)


def cross_colour(argb: np.ndarray, elements: np.ndarray, bits: int, sign: int) -> np.ndarray:
    """sign 1 inverts the transform, -1 applies it."""
    h, w = argb.shape
    _, red_blue, green_blue, green_red = (_spread(c, bits, w, h) for c in _channels(elements))
    a, r, g, b = _channels(argb)
    new_r = r + sign * ((_signed(green_red) * _signed(g)) >> 5)
    b = b + sign * ((_signed(green_blue) * _signed(g)) >> 5)
    b = b + sign * ((_signed(red_blue) * _signed(new_r if sign > 0 else r)) >> 5)
    return _merge(a, new_r, g, b)


def subtract_green(argb: np.ndarray, sign: int) -> np.ndarray:
    a, r, g, b = _channels(argb)
    return _merge(a, r + sign * g, g, b + sign * g)


def _average(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x + y) >> 1


def _select(left, top, corner):
    """Mode 11 of pixels given as (n, 4) channels: left or top, whichever the gradient lies closer to."""
    to_left = np.abs(top - corner).sum(-1, keepdims=True)
    to_top = np.abs(left - corner).sum(-1, keepdims=True)
    return np.where(to_left < to_top, left, top)


def _half(x: np.ndarray) -> np.ndarray:
    """x / 2, rounded towards zero."""
    return np.where(x < 0, -((-x) >> 1), x >> 1)


# Predictors 0 to 13 from left, top, top right and top left, each (n, 4) channels.
PREDICTORS = (
    lambda l, t, tr, tl: np.zeros_like(t) + np.array([255, 0, 0, 0]),
    lambda l, t, tr, tl: l,
    lambda l, t, tr, tl: t,
    lambda l, t, tr, tl: tr,
    lambda l, t, tr, tl: tl,
    lambda l, t, tr, tl: _average(_average(l, tr), t),
    lambda l, t, tr, tl: _average(l, tl),
    lambda l, t, tr, tl: _average(l, t),
    lambda l, t, tr, tl: _average(tl, t),
    lambda l, t, tr, tl: _average(t, tr),
    lambda l, t, tr, tl: _average(_average(l, tl), _average(t, tr)),
    lambda l, t, tr, tl: _select(l, t, tl),
    lambda l, t, tr, tl: np.clip(l + t - tl, 0, 255),
    lambda l, t, tr, tl: np.clip(_average(l, t) + _half(_average(l, t) - tl), 0, 255),
)
NEEDS_LEFT = {5, 6, 7, 10, 11, 12, 13}


def _neighbours(flat: np.ndarray, lo: int, hi: int, w: int) -> tuple:
    return flat[lo - 1 : hi - 1], flat[lo - w : hi - w], flat[lo - w + 1 : hi - w + 1], flat[lo - w - 1 : hi - w - 1]


def unpredict(argb: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    h, w = argb.shape
    flat = np.stack(_channels(argb), -1).reshape(-1, 4)
    flat[0, 0] += 255
    flat[:w] = np.cumsum(flat[:w], 0) & 255
    for y in range(1, h):
        flat[y * w] = (flat[y * w] + flat[(y - 1) * w]) & 255
        x = 1
        while x < w:
            end = min(w, ((x >> bits) + 1) << bits)
            mode, lo, hi = int(modes[y >> bits, x >> bits]), y * w + x, y * w + end
            mode = mode if mode < 14 else 0
            if mode == 1:
                flat[lo:hi] = (np.cumsum(flat[lo:hi], 0) + flat[lo - 1]) & 255
            elif mode in NEEDS_LEFT:
                for i in range(lo, hi):
                    flat[i] = (flat[i] + PREDICTORS[mode](*_neighbours(flat, i, i + 1, w))[0]) & 255
            else:
                flat[lo:hi] = (flat[lo:hi] + PREDICTORS[mode](*_neighbours(flat, lo, hi, w))) & 255
            x = end
    return _merge(*flat.T).reshape(h, w)


def predict(argb: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Residuals: the inverse of unpredict."""
    h, w = argb.shape
    flat = np.stack(_channels(argb), -1).reshape(-1, 4)
    out = flat.copy()
    out[0, 0] -= 255
    out[1:w] -= flat[: w - 1]
    for y in range(1, h):
        out[y * w] -= flat[(y - 1) * w]
        x = 1
        while x < w:
            end = min(w, ((x >> bits) + 1) << bits)
            lo, hi = y * w + x, y * w + end
            out[lo:hi] -= PREDICTORS[int(modes[y >> bits, x >> bits])](*_neighbours(flat, lo, hi, w))
            x = end
    return _merge(*out.T).reshape(h, w)


def decode(data: bytes) -> np.ndarray:
    """The pixels of a WebP file with one VP8L chunk."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    size = int.from_bytes(data[16:20], "little")
    bits = Bits(data[20 : 20 + size])
    if bits.read(8) != 0x2F:
        raise ValueError("wrong signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, seen, w = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind < 2:
            block = bits.read(3) + 2
            image = read_image(bits, -(-w >> block), -(-height >> block), False).reshape(-(-height >> block), -1)
            undo.append((kind, block, image, w))
        elif kind == 2:
            undo.append((kind, 0, None, w))
        else:
            n = bits.read(8) + 1
            table = np.stack(_channels(read_image(bits, n, 1, False)), -1)
            table = _merge(*(np.cumsum(table, 0) & 255).T)
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, pack, table, w))
            w = -(-w >> pack)
    image = read_image(bits, w, height, True).reshape(height, w)
    for kind, block, extra, wide in reversed(undo):
        if kind == 0:
            image = unpredict(image, ((extra >> 8) & 255).astype(np.int64), block)
        elif kind == 1:
            image = cross_colour(image, extra, block, 1)
        elif kind == 2:
            image = subtract_green(image, 1)
        else:
            index = (image >> 8) & 255
            if block:
                each = 8 >> block
                index = ((index[:, :, None] >> (np.arange(1 << block, dtype=np.uint32) * each)) & ((1 << each) - 1)).reshape(height, -1)[:, :wide]
            table = np.zeros(256, np.uint32)
            table[: len(extra)] = extra
            image = table[index]
    return image


# ---- encoding ----


def code_lengths(counts: dict[int, int], most: int = 15) -> dict[int, int]:
    """Huffman code lengths of at most `most` bits."""
    if len(counts) < 2:
        return dict.fromkeys(counts, 1)
    while True:
        heap = [(c, s, None) for s, c in counts.items()]
        heapq.heapify(heap)
        serial = 1 << 20
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], serial, (a, b)))
            serial += 1
        out, stack = {}, [(heap[0], 0)]
        while stack:
            (_, s, kids), depth = stack.pop()
            if kids is None:
                out[s] = depth
            else:
                stack += [(kids[0], depth + 1), (kids[1], depth + 1)]
        if max(out.values()) <= most:
            return out
        counts = {s: (c >> 1) | 1 for s, c in counts.items()}


class Writer:
    """Bits as one growing number for headers, and arrays of (value, size) for pixels."""

    def __init__(self):
        self.value, self.size = 0, 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def put(self, value: int, size: int) -> None:
        self.value |= value << self.size
        self.size += size

    def settle(self) -> None:
        n = -(-self.size // 32)
        if n:
            words = np.frombuffer(self.value.to_bytes(4 * n, "little"), "<u4").astype(np.uint64)
            sizes = np.full(n, 32, np.int64)
            sizes[-1] = self.size - 32 * (n - 1)
            self.parts.append((words, sizes))
        self.value = self.size = 0

    def put_array(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.settle()
        self.parts.append((values.astype(np.uint64), sizes.astype(np.int64)))

    def bytes(self) -> bytes:
        self.settle()
        values, sizes = np.concatenate([v for v, _ in self.parts]), np.concatenate([s for _, s in self.parts])
        values, sizes = values[sizes > 0], sizes[sizes > 0]
        end = np.cumsum(sizes)
        start, total = end - sizes, int(end[-1])
        shifted, word = values << (start & 31).astype(np.uint64), start >> 5
        first = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
        out = np.zeros((total >> 5) + 2, np.uint64)
        out[word[first]] = np.bitwise_or.reduceat(shifted, first)  # those that begin in a word; none is longer than 32 bits
        out[1:] |= out[:-1] >> np.uint64(32)
        return (out & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()[: (total + 7) >> 3]


# A complete code for code lengths: symbols 0 to 12 take 4 bits, 13 to 18 take 5.
_META = {s: 4 if s < 13 else 5 for s in range(19)}
_META_CODES = canonical([(n, s) for s, n in _META.items()])


def _meta_header() -> tuple[int, int]:
    """The bits that announce that code: not a simple one, all 19 lengths, no limit on the symbols."""
    w = Writer()
    w.put(0, 1), w.put(15, 4)
    for k in LENGTH_ORDER:
        w.put(_META[k], 3)
    w.put(0, 1)
    return w.value, w.size


_META_HEADER = _meta_header()


def code_header(lengths: dict[int, int], size: int) -> tuple[int, int]:
    """The bits that describe a code, as (value, size)."""
    w = Writer()
    if len(lengths) <= 1 and (next(iter(lengths), 0)) < 256:
        w.put(1, 1), w.put(0, 1), w.put(1, 1), w.put(next(iter(lengths), 0), 8)
        return w.value, w.size
    value, length, at = *_META_HEADER, 0
    for s in [*sorted(lengths), size]:
        gap = s - at
        while gap:
            n = min(gap, 138)
            if gap >= 11:
                (c, k), extra, more = _META_CODES[18], n - 11, 7
            elif gap >= 3:
                (c, k), extra, more = _META_CODES[17], n - 3, 3
            else:
                (c, k), extra, more, n = _META_CODES[0], 0, 0, 1
            value |= (c | extra << k) << length
            length += k + more
            gap -= n
        if s < size:
            c, k = _META_CODES[lengths[s]]
            value |= c << length
            length += k
        at = s + 1
    return value, length


def _coder(lengths: dict[int, int], size: int) -> tuple[np.ndarray, np.ndarray]:
    codes, sizes = np.zeros(size, np.uint64), np.zeros(size, np.int64)
    if len(lengths) > 1:
        for s, (c, n) in canonical([(n, s) for s, n in lengths.items()]).items():
            codes[s], sizes[s] = c, n
    return codes, sizes


def _prefix(value: int) -> tuple[int, int, int]:
    """Prefix, extra value and extra size of a length or distance code."""
    if value <= 4:
        return value - 1, 0, 0
    high = (value - 1).bit_length() - 1
    second = ((value - 1) >> (high - 1)) & 1
    return 2 * high + second, (value - 1) & ((1 << (high - 1)) - 1), high - 1


#: Copies of fewer pixels cost about as much as they save.
LEAST_COPY, MOST_COPY = 6, 4096
MIX = np.random.default_rng(3).integers(0, 1 << 63, LEAST_COPY, np.uint64) * np.uint64(2) + np.uint64(1)


def find_copies(flat: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of runs that repeat earlier pixels, taken greedily from the left."""
    n = len(flat) - LEAST_COPY + 1
    if n < 2:
        return []
    key = sum(flat[k : k + n].astype(np.uint64) * MIX[k] for k in range(LEAST_COPY))
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    if not len(same):
        return []
    here, before = order[same + 1], order[same]
    by_place = np.argsort(here)
    out, end = [], 0
    for i, j in zip(here[by_place].tolist(), before[by_place].tolist(), strict=True):
        if i < end:
            continue
        length = 0
        for most in (64, MOST_COPY):
            most = min(most, len(flat) - i)
            other = flat[i : i + most] != flat[j : j + most]
            length = int(other.argmax()) if other.any() else most
            if length < most:
                break
        if length >= LEAST_COPY:
            out.append((i, length, i - j))
            end = i + length
    return out


def _write_copies(w: Writer, flat: np.ndarray, wide: int, main: bool, copies: list[tuple[int, int, int]]) -> None:
    """Opaque pixels as literals and back-references, whose codes are worked out in arrays."""
    if main:
        w.put(0, 1)
    at, length, back = np.array(copies, np.int64).T
    covered = np.zeros(len(flat) + 1, np.int64)
    covered[at] += 1
    covered[at + length] -= 1
    literal = np.flatnonzero(np.cumsum(covered[:-1]) == 0)
    near = np.arange(8 * wide + 9, dtype=np.int64) + 120
    for k, (x, y) in reversed(list(enumerate(NEAR))):
        if x + y * wide >= 1:
            near[x + y * wide] = k + 1
    far = np.where(back < len(near), near[np.minimum(back, len(near) - 1)], back + 120)
    parts = [np.array([_prefix(int(x)) for x in values], np.int64).T for values in (length, far)]
    planes = [((flat[literal] >> s) & 255).astype(np.int64) for s in (8, 16, 0)]
    places = np.argsort(np.concatenate([literal, at]), kind="stable")
    values, sizes = np.zeros((len(places), 4), np.uint64), np.zeros((len(places), 4), np.int64)

    def coded(size: int, *parts: np.ndarray) -> tuple[tuple[int, int], np.ndarray, np.ndarray]:
        """A header and the codes of an alphabet that the parts share."""
        n = sum(np.bincount(x, minlength=size) for x in parts)
        found = np.flatnonzero(n)
        lengths = code_lengths(dict(zip(found.tolist(), n[found].tolist(), strict=True)))
        return code_header(lengths, size), *_coder(lengths, size)

    first, rest, away = np.concatenate([planes[0], 256 + parts[0][0]]), coded(256, *planes[1:]), coded(40, parts[1][0])
    header, codes, bits = coded(280, first)
    values[:, 0], sizes[:, 0] = codes[first], bits[first]
    for k in (1, 2):
        values[: len(literal), k], sizes[: len(literal), k] = rest[1][planes[k]], rest[2][planes[k]]
    values[len(literal) :, 2], sizes[len(literal) :, 2] = away[1][parts[1][0]], away[2][parts[1][0]]
    for part in (header, rest[0], rest[0], code_header({255: 1}, 256), away[0]):
        w.put(*part)
    for column, (_, extra, size) in zip((1, 3), parts, strict=True):
        values[len(literal) :, column], sizes[len(literal) :, column] = extra, size
    w.put_array(values[places].reshape(-1), sizes[places].reshape(-1))


def write_image(w: Writer, argb: np.ndarray, main: bool, cache_bits: int = 0, lz: bool = False, groups: int = 1, copies: bool = False) -> None:
    """An entropy-coded image; groups > 1 deals blocks of 4 x 4 out to several groups of codes, copies looks for long repeats."""
    h, wide = argb.shape
    flat = argb.reshape(-1)
    # A literal pixel takes about 12 bits, a copy 30, and codes of their own for copies some 600.
    found = find_copies(flat) if copies and (flat >> 24 == 255).all() else []
    if 12 * sum(n for _, n, _ in found) > 30 * len(found) + 600:
        w.put(0, 1)
        _write_copies(w, flat, wide, main, found)
        return
    w.put(1, 1) or w.put(cache_bits, 4) if cache_bits else w.put(0, 1)
    if cache_bits or lz or groups > 1:
        _write_tokens(w, flat, wide, h, main, cache_bits, lz, groups)
        return
    if main:
        w.put(0, 1)
    planes = [((flat >> s) & 255).astype(np.int64) for s in (8, 16, 0, 24)]
    counts = [np.bincount(p, minlength=256) for p in planes]
    varied = [k for k in range(3) if np.count_nonzero(counts[k]) > 1]
    # Channels of a like kind share one code: it is worked out once.
    shared = sum(counts[k] for k in varied) if varied else None
    symbols = np.flatnonzero(shared) if varied else []
    lengths = code_lengths(dict(zip(symbols.tolist(), shared[symbols].tolist(), strict=True))) if varied else {}
    header = {n: code_header(lengths, n) for n in (280, 256)} if varied else {}
    for k in range(4):
        w.put(*(header[ALPHABETS[k]] if k in varied else code_header({int(planes[k][0]): 1} if k < 3 or not np.count_nonzero(counts[3]) > 1 else code_lengths({int(s): int(counts[3][s]) for s in np.flatnonzero(counts[3])}), ALPHABETS[k])))
    w.put(*code_header({}, 40))
    columns = []
    codes, sizes = _coder(lengths, 256)
    for k in range(3):
        if k in varied:
            columns.append((codes[planes[k]], sizes[planes[k]]))
    if np.count_nonzero(counts[3]) > 1:
        c, s = _coder(code_lengths({int(s): int(counts[3][s]) for s in np.flatnonzero(counts[3])}), 256)
        columns.append((c[planes[3]], s[planes[3]]))
    if columns:
        w.put_array(np.stack([c for c, _ in columns], 1).reshape(-1), np.stack([s for _, s in columns], 1).reshape(-1))


def _write_tokens(w: Writer, flat: np.ndarray, wide: int, h: int, main: bool, cache_bits: int, lz: bool, groups: int) -> None:
    pixels, n = flat.tolist(), len(flat)
    near = {x + y * wide: k + 1 for k, (x, y) in reversed(list(enumerate(NEAR))) if x + y * wide >= 1}
    across, block = -(-wide >> 2), 2
    meta = [(k * 7 + k // across) % groups for k in range(across * -(-h >> block))]
    groups = max(meta) + 1
    tokens, seen, cache, i = [], {}, [None] * (1 << cache_bits) if cache_bits else None, 0
    while i < n:
        length, back = 0, 0
        if lz and i + 3 <= n:
            at = seen.get(tuple(pixels[i : i + 3]))
            if at is not None:
                while i + length < n and length < 4096 and pixels[at + length] == pixels[i + length]:
                    length += 1
                back = i - at
        own = meta[((i // wide) >> block) * across + ((i % wide) >> block)]
        if length >= 3:
            tokens.append((own, length, near.get(back, back + 120)))
        else:
            length = 1
            slot = ((pixels[i] * CACHE_MULTIPLIER) & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
            tokens.append((own, -1, slot) if cache and cache[slot] == pixels[i] else (own, 0, pixels[i]))
        for k in range(i, i + length):
            if lz and k + 3 <= n:
                seen[tuple(pixels[k : k + 3])] = k
            if cache:
                cache[((pixels[k] * CACHE_MULTIPLIER) & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[k]
        i += length
    counts = [[{} for _ in range(5)] for _ in range(groups)]
    flow = []  # (group, code, symbol, extra, extra size)
    for own, kind, x in tokens:
        if kind == 0:
            flow += [(own, k, (x >> s) & 255, 0, 0) for k, s in enumerate((8, 16, 0, 24))]
        elif kind < 0:
            flow.append((own, 0, 280 + x, 0, 0))
        else:
            p, e, size = _prefix(kind)
            flow.append((own, 0, 256 + p, e, size))
            p, e, size = _prefix(x)
            flow.append((own, 4, p, e, size))
    for own, k, s, _, _ in flow:
        counts[own][k][s] = counts[own][k].get(s, 0) + 1
    if main:
        w.put(int(groups > 1), 1)
        if groups > 1:
            w.put(block - 2, 3)
            write_image(w, (np.array(meta, np.uint32) << 8).reshape(-1, across), False)
    coders = []
    for own in counts:
        coders.append([])
        for k, c in enumerate(own):
            size = ALPHABETS[k] + ((1 << cache_bits) if cache_bits and not k else 0)
            lengths = code_lengths(c)
            w.put(*code_header(lengths, size))
            coders[-1].append(_coder(lengths, size))
    values, sizes = [], []
    for own, k, s, extra, size in flow:
        codes, n_bits = coders[own][k]
        values += [int(codes[s]), extra]
        sizes += [int(n_bits[s]), size]
    w.put_array(np.array(values, np.uint64), np.array(sizes, np.int64))


def encode(argb: np.ndarray, predictor: int | None = None, cross: tuple[int, int, int] | None = None, green: bool = False, palette: bool = False, cache_bits: int = 0, lz: bool = False, groups: int = 1, copies: bool = False) -> bytes:
    """A WebP file of the pixels; predictor -1 takes all modes in turn, cross holds green-to-red, green-to-blue, red-to-blue."""
    h, wide = argb.shape
    w = Writer()
    w.put(0x2F, 8), w.put(wide - 1, 14), w.put(h - 1, 14), w.put(int(bool((argb >> 24 != 255).any())), 1), w.put(0, 3)
    image = argb.astype(np.uint32)
    if palette:
        table, index = np.unique(image, return_inverse=True)
        if len(table) > 256:
            raise ValueError("too many colours for a palette")
        w.put(1, 1), w.put(3, 2), w.put(len(table) - 1, 8)
        own = np.stack(_channels(table), -1)
        write_image(w, _merge(*np.diff(own, axis=0, prepend=np.zeros((1, 4), np.int32)).T).reshape(1, -1), False)
        pack = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
        index = index.reshape(h, wide).astype(np.uint32)
        if pack:
            index = np.pad(index, ((0, 0), (0, -wide % (1 << pack)))).reshape(h, -1, 1 << pack)
            index = np.bitwise_or.reduce(index << (np.arange(1 << pack, dtype=np.uint32) * (8 >> pack)), -1)
        image = (index << 8 | 0xFF000000).astype(np.uint32)
    h, wide = image.shape
    if predictor is not None:
        modes = (np.arange(-(-wide >> 2) * -(-h >> 2)) % 14 if predictor < 0 else np.full(-(-wide >> 2) * -(-h >> 2), predictor)).reshape(-(-h >> 2), -1)
        w.put(1, 1), w.put(0, 2), w.put(0, 3)
        write_image(w, (modes << 8).astype(np.uint32), False)
        image = predict(image, modes, 2)
    if cross:
        w.put(1, 1), w.put(1, 2), w.put(1, 3)
        elements = np.full((-(-h >> 3), -(-wide >> 3)), 0xFF000000 | (cross[2] & 255) << 16 | (cross[1] & 255) << 8 | (cross[0] & 255), np.uint32)
        write_image(w, elements, False)
        image = cross_colour(image, elements, 3, -1)
    if green:
        w.put(1, 1), w.put(2, 2)
        image = subtract_green(image, -1)
    w.put(0, 1)
    write_image(w, image, True, cache_bits, lz, groups, copies)
    body = w.bytes()
    padded = body + b"\0" * (len(body) & 1)
    return b"RIFF" + (12 + len(padded)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + padded


def entropy(*planes: np.ndarray) -> float:
    """Bits that ideal codes of the planes would take."""
    bits = 0.0
    for p in planes:
        counts = np.bincount(p.reshape(-1) & 255, minlength=256)
        counts = counts[counts > 0]
        bits += float(counts.sum() * np.log2(counts.sum()) - counts @ np.log2(counts))
    return bits


def transforms(argb: np.ndarray, most_rows: int = 16) -> dict:
    """The transforms that should shorten the file most, estimated on at most so many rows spread over the image.

    A transform is worth an estimate of its size only where channels go together or neighbours are alike.
    """
    some = argb[:: -(-len(argb) // most_rows)]
    channels = ((some[None] >> np.array([16, 8, 0], np.uint32)[:, None, None]) & 255).astype(np.int32)
    r, g, b = channels
    flat = channels.reshape(3, -1) - channels.reshape(3, -1).mean(1, keepdims=True)
    spread, with_red, with_blue = (float(x) for x in flat[1] @ flat.T[:, [1, 0, 2]])
    steps = float(np.abs(np.diff(channels, axis=2)).mean()) if some.shape[1] > 1 else 0.0
    alike, together = steps < 0.5 * float(np.abs(flat).mean()), abs(with_red) + abs(with_blue) > 0.6 * spread > 0
    if not (alike or together):
        return {}
    least, best = 0.97 * entropy(r, g, b), {}
    tried = []
    if together:
        tried.append(({"green": True}, entropy(g) + entropy(r - g) + entropy(b - g) + 16))
        to_red, to_blue = (int(np.clip(np.rint(32 * x / spread), -128, 127)) for x in (with_red, with_blue))
        tried.append(({"cross": (to_red, to_blue, 0)}, entropy(g) + entropy(r - ((to_red * _signed(g)) >> 5)) + entropy(b - ((to_blue * _signed(g)) >> 5)) + 120))
    if alike:
        tried.append(({"predictor": 1}, sum(entropy(np.diff(c, axis=1, prepend=0)) for c in (r, g, b)) + 120))
    for own, bits in tried:
        if bits < least:
            least, best = bits, own
    return best


def encode_smallest(argb: np.ndarray) -> bytes:
    """The file with the transforms that pay and with back-references, or that with a palette where it is smaller."""
    out = encode(argb, copies=True, **transforms(argb))
    flat = argb.reshape(-1)
    # Colours that hardly repeat cost more in a table than as they are.
    few = len(np.unique(flat[:1024]))
    if few <= 256 and 4 * few <= min(len(flat), 1024) and 4 * len(np.unique(flat)) <= min(len(flat), 1024):
        other = encode(argb, palette=True, copies=True)
        return min(out, other, key=len)
    return out
