"""The greedy encoders one byte at a time, which the engine's must equal byte for byte."""


def lznt1_encode(data: bytes) -> bytes:
    """Chunks of 4 KiB with greedy matches."""
    out = bytearray()
    for a in range(0, len(data), 4096):
        chunk, body, at, seen = data[a : a + 4096], bytearray(), 0, {}
        while at < len(chunk):
            spot, flags = len(body), 0
            body.append(0)
            for bit in range(8):
                if at >= len(chunk):
                    break
                split = max(4, (at - 1).bit_length()) if at else 4
                key, size = chunk[at : at + 3], 0
                from_ = seen.get(key, -1) if len(key) == 3 else -1
                if from_ >= 0 and at - from_ <= 1 << split:
                    while at + size < len(chunk) and size < (0xFFFF >> split) + 3 and chunk[from_ + size] == chunk[at + size]:
                        size += 1
                if size >= 3:
                    flags |= 1 << bit
                    body += ((at - from_ - 1) << (16 - split) | (size - 3)).to_bytes(2, "little")
                else:
                    size = 1
                    body.append(chunk[at])
                for k in range(size):
                    seen[chunk[at + k : at + k + 3]] = at + k
                at += size
            body[spot] = flags
        if len(body) < len(chunk) or len(chunk) == 1:
            out += (0xB000 | (len(body) - 1)).to_bytes(2, "little") + body
        else:
            out += (0x3000 | (len(chunk) - 1)).to_bytes(2, "little") + chunk
    return bytes(out + b"\0\0")


def xpress_encode(data: bytes) -> bytes:
    tokens, at, seen = [], 0, {}
    while at < len(data):
        key, size = data[at : at + 3], 0
        from_ = seen.get(key, -1) if len(key) == 3 else -1
        if from_ >= 0 and at - from_ <= 8192:
            while at + size < len(data) and size < 9 and data[from_ + size] == data[at + size]:
                size += 1
        if size >= 3:
            tokens.append((True, ((at - from_ - 1) << 3 | (size - 3)).to_bytes(2, "little")))
        else:
            size = 1
            tokens.append((False, data[at : at + 1]))
        for k in range(size):
            seen[data[at + k : at + k + 3]] = at + k
        at += size
    out = bytearray()
    for g in range(0, len(tokens) + 1, 32):
        group = tokens[g : g + 32]
        flags = sum(1 << (31 - i) for i, t in enumerate(group) if t[0])
        flags |= (1 << (32 - len(group))) - 1 if len(group) < 32 else 0
        out += flags.to_bytes(4, "little") + b"".join(t[1] for t in group)
    return bytes(out)


def xpress_huffman_encode(data: bytes) -> bytes:
    """Greedy matches under an almost flat complete code."""
    tokens, at, seen = [], 0, {}
    while at < len(data):
        key, size = data[at : at + 3], 0
        from_ = seen.get(key, -1) if len(key) == 3 else -1
        if from_ >= 0 and at - from_ < 1 << 16:
            while at + size < len(data) and size < 60_000 and data[from_ + size] == data[at + size]:
                size += 1
        back = at - from_
        if size >= 3:
            tokens.append((256 + 16 * (back.bit_length() - 1) + min(size - 3, 15), back, size))
        else:
            size = 1
            tokens.append((data[at], 0, 1))
        for k in range(size):
            seen[data[at + k : at + k + 3]] = at + k
        at += size
    tokens.append((256, 1, 3))
    used = sorted({t[0] for t in tokens} | {0, 256})
    deep = (len(used) - 1).bit_length()
    short = (1 << deep) - len(used)
    lengths, codes, code = dict.fromkeys(range(512), 0), {}, 0
    for i, s in enumerate(used):
        lengths[s] = deep - 1 if i < short else deep
        codes[s] = format(code >> (deep - lengths[s]), f"0{lengths[s]}b")
        code += 1 << (deep - lengths[s])
    out, slots, stream, left = bytearray(lengths[2 * i] | lengths[2 * i + 1] << 4 for i in range(256)), [], [], 0

    def need(n: int) -> None:
        nonlocal left
        while left < n:
            slots.append(len(out))
            out.extend(b"\0\0")
            left += 16

    def put(text: str) -> None:
        nonlocal left
        stream.append(text)
        left -= len(text)

    need(32)
    for symbol, back, size in tokens:
        need(15)
        put(codes[symbol])
        if symbol < 256:
            continue
        if size >= 18:
            out += bytes([size - 18]) if size < 273 else b"\xff" + (size - 3).to_bytes(2, "little")
        span = (symbol - 256) // 16
        if span:
            need(span)
            put(format(back - (1 << span), f"0{span}b"))
    text = "".join(stream).ljust(16 * len(slots), "0")
    for i, slot in enumerate(slots):
        out[slot : slot + 2] = int(text[16 * i : 16 * i + 16], 2).to_bytes(2, "little")
    return bytes(out)
