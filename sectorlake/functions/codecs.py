"""Decompression of LZNT1 and XPRESS, each (data, error), and greedy encoders.

Encoders take many inputs at a time: the place where the three bytes at a
position last occurred, and how far both agree, come from NumPy for all
positions at once; only the walk from token to token is a Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .layout import MAX_UNIT

BLOCK = 1 << 18  # bytes whose matches are sought at once
_SURE = 16  # longer matches are measured where a token begins


def _repeat(out: bytearray, back: int, size: int) -> None:
    """Appends ``size`` bytes from ``back`` bytes before the end, which may overlap what they append."""
    at = len(out) - back
    if size <= back:
        out += out[at : at + size]
    else:
        out += (bytes(out[at:]) * (size // back + 1))[:size]


# ---- matches -----------------------------------------------------------------

def _found(body: np.ndarray, begin: np.ndarray, end: np.ndarray, window: int, most: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """(step, back) for all positions: the length of the match with the last place of
    the same three bytes, 1 without one, -1 where it is longer than _SURE; the
    distance.  Positions match from their ``begin`` to their ``end``."""
    n = len(body) - 16
    step, back = np.ones(n, np.int32), np.zeros(n, np.int32)
    for lo in range(0, n, BLOCK):
        hi, base = min(n, lo + BLOCK), max(0, lo - window)
        b = body[base : hi + 16]
        key = b[:-16].astype(np.uint64) | b[1:-15].astype(np.uint64) << np.uint64(8) | b[2:-14].astype(np.uint64) << np.uint64(16)
        key = np.sort(key << np.uint64(32) | np.arange(hi - base, dtype=np.uint64))
        place = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        same = np.flatnonzero(key[1:] >> np.uint64(32) == key[:-1] >> np.uint64(32))
        at, was = place[same + 1] + base, place[same] + base
        ok = (at >= lo) & (at + 3 <= end[at]) & (was >= begin[at]) & (at - was <= window)
        at, was = at[ok], was[ok]
        word = np.ndarray(len(b) - 7, "<u8", b.tobytes(), strides=(1,))
        size, live = np.zeros(len(at), np.int64), np.arange(len(at))
        for k in range(0, _SURE, 8):
            x = word[at[live] + k - base] ^ word[was[live] + k - base]
            got = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3
            size[live] += got
            live = live[got == 8]
        limit = np.minimum(end[at] - at, most if isinstance(most, int) else most[at])
        step[at] = np.where((size == _SURE) & (limit > _SURE), -1, np.minimum(size, limit))
        back[at] = at - was
    return step, back


def _agree(body: bytes, a: int, b: int, most: int) -> int:
    """How many bytes from a and from b on are the same, of which _SURE are known to be."""
    lo, wide = _SURE, 64
    while True:
        hi = min(lo + wide, most)
        if body[a + lo : a + hi] != body[b + lo : b + hi]:
            break
        if hi == most:
            return most
        lo, wide = hi, 2 * wide
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if body[a + lo : a + mid] == body[b + lo : b + mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _tokens(parts: list[bytes], window: int, most: int, cut: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each part its bytes and its tokens: places, sizes (1: a byte as it is),
    distances.  With ``cut``, parts are matched in pieces of that size, and a match
    has ``most`` bytes at the start of a piece, half as many at each doubling of 16."""
    size = np.array([len(p) for p in parts], np.int64)
    n, bound = int(size.sum()), np.concatenate([[0], np.cumsum(size)])
    body = np.frombuffer(b"".join(parts) + bytes(16), np.uint8)
    begin, end = np.repeat(bound[:-1], size), np.repeat(bound[1:], size)
    limit: np.ndarray | int = most
    if cut:
        at = np.arange(n) - begin
        begin = begin + at // cut * cut
        end = np.minimum(end, begin + cut)
        limit = (0xFFFF >> _split(np.arange(n) - begin)) + 3
    step, back = _found(body, begin, end, window, limit)
    jumps, raw, starts, at = step.tolist(), body.tobytes(), [], 0
    while at < n:
        starts.append(at)
        k = jumps[at]
        if k < 0:
            k = step[at] = _agree(raw, at - int(back[at]), at, min(int(end[at]) - at, most if isinstance(limit, int) else int(limit[at])))
        at += k
    starts = np.array(starts, np.int64)
    edge = np.searchsorted(starts, bound)
    for i, (a, z) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
        at = starts[a:z]
        yield body[bound[i] : bound[i + 1]], at - bound[i], step[at].astype(np.int64), back[at].astype(np.int64)


def _split(at: np.ndarray) -> np.ndarray:
    """Bits of a distance at a place of a chunk."""
    return np.maximum(4, np.frexp(np.maximum(at - 1, 0).astype(np.float64))[1])


# ---- codecs ------------------------------------------------------------------

def lznt1(raw: bytes) -> tuple[bytes | None, str | None]:
    out, at = bytearray(), 0
    while at + 2 <= len(raw):
        header = raw[at] | raw[at + 1] << 8
        if header & 0xFFF == 0:
            break
        end, start = at + 3 + (header & 0xFFF), len(out)
        if end > len(raw):
            return None, "truncated chunk"
        at += 2
        if not header & 0x8000:
            out += raw[at:end]
            at = end
        while at < end:
            flags = raw[at]
            at += 1
            for plain in _PLAIN[flags]:
                if plain:
                    out += raw[at : min(at + plain, end)]
                    at += plain
                if at >= end:
                    break
                if at + 2 > end:
                    return None, "truncated pointer"
                token = raw[at] | raw[at + 1] << 8
                at += 2
                done = len(out)
                split = (done - start - 1).bit_length()
                if split < 4:
                    split = 4
                back, size = (token >> (16 - split)) + 1, (token & (0xFFFF >> split)) + 3
                if back > done - start:
                    return None, "bad back reference"
                if size <= back:
                    out += out[done - back : done - back + size]
                else:
                    _repeat(out, back, size)
            plain = _AFTER[flags]
            if plain and at < end:
                out += raw[at : min(at + plain, end)]
                at += plain
            if len(out) > MAX_UNIT:
                return None, "too large"
        at = end
        if len(out) > MAX_UNIT:
            return None, "too large"
    return bytes(out), None


#: For eight flags, lowest first: how many plain bytes lie before each match, and after the last.
_PLAIN = [[len(x) for x in f"{f:08b}"[::-1].split("1")[:-1]] for f in range(256)]
_AFTER = [len(f"{f:08b}"[::-1].split("1")[-1]) for f in range(256)]


def lznt1_encode_all(parts: list[bytes]) -> list[bytes]:
    """Each part in chunks of 4 KiB with greedy matches."""
    out = []
    for body, at, size, back in _tokens(parts, 4096, 0, cut=4096):
        if not len(at):
            out.append(b"\0\0")
            continue
        chunk = at // 4096
        bound = np.searchsorted(chunk, np.arange(chunk[-1] + 2))
        j, match = np.arange(len(at)) - bound[chunk], size > 1
        head = j % 8 == 0
        past = np.cumsum(1 + match + head)
        packed = np.zeros(past[-1], np.uint8)
        split = _split(at - chunk * 4096)
        value = np.where(match, (back - 1) << (16 - split) | (size - 3), body[at])
        spot = past - 1 - match
        packed[spot] = value & 0xFF
        packed[spot[match] + 1] = value[match] >> 8
        packed[spot[head] - 1] = np.bitwise_or.reduceat(match << (j % 8), np.flatnonzero(head))
        raw, data, made, a = packed.tobytes(), body.tobytes(), [], 0
        for i, z in enumerate(past[bound[1:] - 1].tolist()):
            whole = data[4096 * i : 4096 * i + 4096]
            short = z - a < len(whole) or len(whole) == 1
            made += [((0xB000 if short else 0x3000) | ((z - a if short else len(whole)) - 1)).to_bytes(2, "little"), raw[a:z] if short else whole]
            a = z
        out.append(b"".join(made) + b"\0\0")
    return out


def lznt1_encode(data: bytes) -> bytes:
    return lznt1_encode_all([data])[0]


def xpress(raw: bytes) -> tuple[bytes | None, str | None]:
    """Plain LZ77: 32 flags a group, highest bit first."""
    out, at, nibble, n = bytearray(), 0, None, len(raw)
    while True:
        if at + 4 > n:
            return None, "end of stream"
        flags, bits = int.from_bytes(raw[at : at + 4], "little"), 32
        at += 4
        while bits:
            plain = bits - flags.bit_length()
            if plain:
                if at + plain > n:
                    return None, "end of stream"
                out += raw[at : at + plain]
                at += plain
                bits -= plain
                if not bits:
                    break
            bits -= 1
            flags &= (1 << bits) - 1
            if at == n:
                return bytes(out), None
            if at + 2 > n:
                return None, "end of stream"
            token = raw[at] | raw[at + 1] << 8
            at += 2
            back, size = (token >> 3) + 1, token & 7
            if size == 7:
                if nibble is None:
                    if at >= n:
                        return None, "end of stream"
                    nibble, size = at, raw[at] & 15
                    at += 1
                else:
                    size, nibble = raw[nibble] >> 4, None
                if size == 15:
                    if at >= n:
                        return None, "end of stream"
                    size = raw[at]
                    at += 1
                    if size == 255:
                        size = int.from_bytes(raw[at : at + 2], "little")
                        at += 2
                        if size == 0:
                            size = int.from_bytes(raw[at : at + 4], "little")
                            at += 4
                        if size < 22:
                            return None, "corrupt length"
                        size -= 22
                    size += 15
                size += 7
            size += 3
            done = len(out)
            if back > done:
                return None, "bad back reference"
            if done + size > MAX_UNIT:
                return None, "too large"
            if size <= back:
                out += out[done - back : done - back + size]
            else:
                _repeat(out, back, size)


def xpress_encode_all(parts: list[bytes]) -> list[bytes]:
    out = []
    for body, at, size, back in _tokens(parts, 8192, 9):
        if not len(at):
            out.append(b"\xff" * 4)
            continue
        j, match = np.arange(len(at)), size > 1
        head = j % 32 == 0
        past = np.cumsum(1 + match + 4 * head)
        packed = np.zeros(past[-1], np.uint8)
        value = np.where(match, (back - 1) << 3 | (size - 3), body[at])
        spot = past - 1 - match
        packed[spot] = value & 0xFF
        packed[spot[match] + 1] = value[match] >> 8
        flags = np.bitwise_or.reduceat(match.astype(np.int64) << (31 - j % 32), np.flatnonzero(head))
        rest = len(at) % 32
        if rest:
            flags[-1] |= (1 << (32 - rest)) - 1
        for k in range(4):
            packed[spot[head] - 4 + k] = flags >> 8 * k & 0xFF
        out.append(packed.tobytes() + (b"" if rest else b"\xff" * 4))
    return out


def xpress_encode(data: bytes) -> bytes:
    return xpress_encode_all([data])[0]


def xpress_huffman(raw: bytes, size: int) -> tuple[bytes | None, str | None]:
    """LZ77 under one canonical Huffman code: literals, then 256 + 16 * log2(distance) + length.
    Symbol 256 ends the stream at ``size`` bytes and is a match of three at distance one before.

    Bits are those of little-endian 16-bit words, highest first.  A word is fetched
    only when more bits are asked for than are left, so single bytes that lie
    between words are taken where the next word would be."""
    lengths = [n for b in raw[:256] for n in (b & 15, b >> 4)]
    ranked = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(raw) < 256 or sum(1 << (15 - n) for n, _ in ranked) != 1 << 15:
        return None, "bad code"
    deep = ranked[-1][0]
    table, most = [], (1 << deep) - 1
    for n, s in ranked:
        table += [s << 4 | n] * (1 << (deep - n))
    out, n, at, left = bytearray(), len(raw), 260, 32
    if n < 260:
        return None, "end of stream"
    held = (raw[256] | raw[257] << 8) << 16 | raw[258] | raw[259] << 8
    append = out.append
    while True:
        if left < 15:
            if at + 2 > n:
                break
            held = (held & (1 << left) - 1) << 16 | raw[at] | raw[at + 1] << 8
            at += 2
            left += 16
        symbol = table[held >> (left - deep) & most]
        left -= symbol & 15
        symbol >>= 4
        if symbol < 256:
            append(symbol)  # whether it fits is seen at the next match
            continue
        done = len(out)
        if done > size:
            return None, "corrupt stream"
        if symbol == 256 and done == size:
            return bytes(out), None
        span, count = (symbol >> 4) - 16, symbol & 15
        if count == 15:
            if at >= n:
                break
            count = raw[at] + 15
            at += 1
            if count == 270:
                for wide in (2, 4):
                    if at + wide > n:
                        return None, "end of stream"
                    count = int.from_bytes(raw[at : at + wide], "little")
                    at += wide
                    if count:
                        break
        if left < span:
            if at + 2 > n:
                break
            held = (held & (1 << left) - 1) << 16 | raw[at] | raw[at + 1] << 8
            at += 2
            left += 16
        left -= span
        back = 1 << span | held >> left & (1 << span) - 1
        count += 3
        if done + count > MAX_UNIT:
            return None, "too large"
        if back > done or done + count > size:
            return None, "corrupt stream"
        if count <= back:
            out += out[done - back : done - back + count]
        else:
            _repeat(out, back, count)
    return None, "corrupt stream" if len(out) > size else "end of stream"


def xpress_huffman_encode_all(parts: list[bytes]) -> list[bytes]:
    """Greedy matches under an almost flat complete code."""
    out = []
    for body, at, size, back in _tokens(parts, 65_535, 60_000):
        match = np.append(size > 1, False)
        size, back, plain = np.append(size, 3), np.append(back, 1), np.append(body[at], 0).astype(np.int64)
        span = np.where(match, np.frexp(back.astype(np.float64))[1] - 1, 0).astype(np.int64)
        symbol = np.where(match, 256 + 16 * span + np.minimum(size - 3, 15), plain)
        symbol[-1] = 256
        used = np.union1d(symbol, [0, 256])
        deep = (len(used) - 1).bit_length()
        length = np.where(np.arange(len(used)) < (1 << deep) - len(used), deep - 1, deep)
        room = 1 << (deep - length)
        lengths, codes = np.zeros(512, np.int64), np.zeros(512, np.int64)
        lengths[used], codes[used] = length, (np.cumsum(room) - room) >> (deep - length)
        wide = lengths[symbol] + span
        bits = np.cumsum(wide)
        first = bits - wide
        words = np.maximum(2, (first + 30) >> 4)  # fetched when 15 bits were asked for at each token
        value = (codes[symbol] << span | np.where(match, back - (1 << span), 0)) << (48 - (first & 15) - wide)
        total = int(words[-1])
        word = sum(np.bincount((first >> 4) + k, weights=(value >> (32 - 16 * k) & 0xFFFF).astype(np.float64), minlength=total + 2)[: total + 2] for k in range(3))
        word = word.astype(np.int64)[:total]
        far = np.flatnonzero(match & (size >= 18))
        extra = [bytes([s - 18]) if s < 273 else b"\xff" + (s - 3).to_bytes(2, "little") for s in size[far].tolist()]
        stream = word.astype("<u2").tobytes()
        made, a = [(lengths[::2] | lengths[1::2] << 4).astype(np.uint8).tobytes()], 0
        for w, more in zip((2 * words[far]).tolist(), extra, strict=True):
            made += [stream[a:w], more]
            a = w
        out.append(b"".join(made) + stream[a:])
    return out


def xpress_huffman_encode(data: bytes) -> bytes:
    return xpress_huffman_encode_all([data])[0]
