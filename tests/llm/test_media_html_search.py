"""WebP features against a writer of their own, HTML extraction and exact search."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.llm import html, mtree, webp

M = 0xFFFFFFFF


class Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value, bits):
        self.value |= value << self.n
        self.n += bits

    def bytes(self):
        return self.value.to_bytes(-(-self.n // 8), "little")


def put_lengths(w, lengths):
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        w.put(1, 1), w.put(len(used) - 1, 1), w.put(1, 1)
        for s in used:
            w.put(s, 8)
        return [1 if len(used) == 2 and s in used else 0 for s in range(len(lengths))]
    # Run lengths with the codes 16, 17 and 18.
    items, k = [], 0
    while k < len(lengths):
        run = 1
        while k + run < len(lengths) and lengths[k + run] == lengths[k]:
            run += 1
        if lengths[k] == 0 and run >= 11:
            run = min(run, 138)
            items.append((18, run - 11, 7))
        elif lengths[k] == 0 and run >= 3:
            run = min(run, 10)
            items.append((17, run - 3, 3))
        elif run >= 4:
            run = min(run, 7)
            items.append((lengths[k], 0, 0))
            items.append((16, run - 4, 2))
        else:
            run = 1
            items.append((lengths[k], 0, 0))
        k += run
    weights = [0.0] * 19
    for s, _, _ in items:
        weights[s] += 1
    own = huffman(weights)
    w.put(0, 1), w.put(15, 4)
    for s in webp.CODE_LENGTH_ORDER:
        w.put(own[s], 3)
    w.put(0, 1)
    codes = canonical(own)
    for s, extra, bits in items:
        put_symbol(w, codes, own, s), w.put(extra, bits)
    return lengths


def huffman(weights):
    used = [s for s, x in enumerate(weights) if x]
    if len(used) == 1:
        used.append(1 if used[0] == 0 else 0)
    part = webp.code_lengths([weights[s] or 0.5 for s in used])
    out = [0] * len(weights)
    for s, n in zip(used, part, strict=True):
        out[s] = n
    return out


def canonical(lengths):
    codes, code = {}, 0
    for n in range(1, max(lengths) + 1):
        code <<= 1
        for s, own in enumerate(lengths):
            if own == n:
                codes[s] = code
                code += 1
    return codes


def put_symbol(w, codes, lengths, s):
    if lengths[s]:
        w.put(int(f"{codes[s]:0{lengths[s]}b}"[::-1], 2), lengths[s])


def prefix(value):
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    p = 2 * top + (v >> top - 1 & 1)
    extra = (p - 2) >> 1
    return p, v - ((2 + (p & 1)) << extra), extra


def tokens(pixels, width, cache_bits, rng):
    cache, out, i = {}, [], 0
    while i < len(pixels):
        slot = (pixels[i] * webp.CACHE_FACTOR & M) >> (32 - cache_bits) if cache_bits else 0
        n, d = 0, 0
        for d_ in [1, width, width + 1, rng.randrange(1, 200)] if i else []:
            k = 0
            while d_ <= i and i + k < len(pixels) and k < 50 and pixels[i + k] == pixels[i + k - d_]:
                k += 1
            if k > n:
                n, d = k, d_
        if cache_bits and cache.get(slot) == pixels[i] and rng.random() < 0.8:
            out.append((i, "cache", slot, 0))
            n = 1
        elif n >= 2:
            near = [k + 1 for k, (x, y) in enumerate(webp.NEAR) if max(1, x + y * width) == d]
            out.append((i, "copy", n, near[0] if near else d + 120))
        else:
            out.append((i, "literal", pixels[i], 0))
            n = 1
        for k in range(i, i + n):
            if cache_bits:
                cache[(pixels[k] * webp.CACHE_FACTOR & M) >> (32 - cache_bits)] = pixels[k]
        i += n
    return out


def put_image(w, pixels, width, rng, top=False, cache_bits=0, meta=None):
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if top:
        w.put(1 if meta else 0, 1)
        if meta:
            size_bits, blocks = meta
            w.put(size_bits - 2, 3)
            put_image(w, [0xFF000000 | b << 8 for b in blocks], -(-width >> size_bits), rng)
    of = (lambda i: 0) if not meta else (lambda i: meta[1][(i // width >> meta[0]) * -(-width >> meta[0]) + (i % width >> meta[0])])
    groups = 1 + (max(meta[1]) if meta else 0)
    sizes = (webp.GREEN + (1 << cache_bits if cache_bits else 0), 256, 256, 256, webp.DISTANCE)
    weights = [[[0.0] * n for n in sizes] for _ in range(groups)]
    items = tokens(pixels, width, cache_bits, rng)
    for i, kind, a, b in items:
        g = weights[of(i)]
        if kind == "literal":
            for k, s in enumerate((8, 16, 0, 24)):
                g[k][a >> s & 255] += 1
        elif kind == "cache":
            g[0][webp.GREEN + a] += 1
        else:
            g[0][256 + prefix(a)[0]] += 1
            g[4][prefix(b)[0]] += 1
    lengths = [[put_lengths(w, huffman(x) if any(x) else [0] * len(x)) for x in g] for g in weights]
    codes = [[canonical(x) if any(x) else {} for x in g] for g in lengths]
    for i, kind, a, b in items:
        g, c = lengths[of(i)], codes[of(i)]
        if kind == "literal":
            for k, s in enumerate((8, 16, 0, 24)):
                put_symbol(w, c[k], g[k], a >> s & 255)
        elif kind == "cache":
            put_symbol(w, c[0], g[0], webp.GREEN + a)
        else:
            for k, v, base in ((0, a, 256), (4, b, 0)):
                p, rest, n = prefix(v)
                put_symbol(w, c[k], g[k], base + p), w.put(rest, n)


def parts(p):
    return [p >> s & 255 for s in (24, 16, 8, 0)]


def whole(c):
    return c[0] << 24 | c[1] << 16 | c[2] << 8 | c[3]


def predict(mode, left, top, top_left, top_right):
    average = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    clip = lambda v: max(0, min(255, v))
    if mode == 11:
        p = [a + b - c for a, b, c in zip(left, top, top_left, strict=True)]
        return left if sum(abs(x - y) for x, y in zip(p, left, strict=True)) < sum(abs(x - y) for x, y in zip(p, top, strict=True)) else top
    if mode == 12:
        return [clip(a + b - c) for a, b, c in zip(left, top, top_left, strict=True)]
    if mode == 13:
        return [clip(a + int((a - c) / 2)) for a, c in zip(average(left, top), top_left, strict=True)]
    return [[255, 0, 0, 0], left, top, top_right, top_left, average(average(left, top_right), top), average(left, top_left), average(left, top), average(top_left, top), average(top, top_right), average(average(left, top_left), average(top, top_right))][mode]


def forward(kind, pixels, width, height, rng):
    """The residual image of a transform, what the stream says of it, and the new width."""
    size_bits = 2
    across = -(-width >> size_bits)
    blocks = across * -(-height >> size_bits)
    if kind == webp.SUBTRACT_GREEN:
        return [whole([a, (r - g) & 255, g, (b - g) & 255]) for a, r, g, b in map(parts, pixels)], None, width
    if kind == webp.PREDICTOR:
        modes, out = [rng.randrange(14) for _ in range(blocks)], []
        for i, p in enumerate(pixels):
            y, x = divmod(i, width)
            at = lambda j: parts(pixels[j])
            if not i:
                q = [255, 0, 0, 0]
            elif not y:
                q = at(i - 1)
            elif not x:
                q = at(i - width)
            else:
                q = predict(modes[(y >> size_bits) * across + (x >> size_bits)], at(i - 1), at(i - width), at(i - width - 1), at(i - width + 1))
            out.append(whole([(a - b) & 255 for a, b in zip(parts(p), q, strict=True)]))
        return out, (size_bits, [0xFF000000 | m << 8 for m in modes], across), width
    if kind == webp.CROSS_COLOUR:
        factors = [[255, rng.randrange(256), rng.randrange(256), rng.randrange(256)] for _ in range(blocks)]
        signed = lambda v: v - 256 if v > 127 else v
        out = []
        for i, p in enumerate(pixels):
            y, x = divmod(i, width)
            _, red_blue, green_blue, green_red = factors[(y >> size_bits) * across + (x >> size_bits)]
            a, r, g, b = parts(p)
            out.append(whole([a, (r - (signed(green_red) * signed(g) >> 5)) & 255, g, (b - (signed(green_blue) * signed(g) >> 5) - (signed(red_blue) * signed(r) >> 5)) & 255]))
        return out, (size_bits, [whole(f) for f in factors], across), width
    palette = sorted(set(pixels))
    pack = 3 if len(palette) <= 2 else 2 if len(palette) <= 4 else 1 if len(palette) <= 16 else 0
    index, out = {p: k for k, p in enumerate(palette)}, []
    for y in range(height):
        row = [index[p] for p in pixels[y * width : (y + 1) * width]]
        for x in range(0, width, 1 << pack):
            out.append(0xFF000000 | sum(v << (8 >> pack) * k for k, v in enumerate(row[x : x + (1 << pack)])) << 8)
    deltas = [whole([(a - b) & 255 for a, b in zip(parts(p), parts(q), strict=True)]) for p, q in zip(palette, [0, *palette], strict=False)]
    return out, (None, deltas, len(deltas)), -(-width >> pack)


def file_of(pixels, width, height, kinds, cache_bits, meta, rng):
    w = Writer()
    w.put(0x2F, 8), w.put(width - 1, 14), w.put(height - 1, 14), w.put(1, 1), w.put(0, 3)
    for kind in kinds:
        pixels, said, new = forward(kind, pixels, width, height, rng)
        w.put(1, 1), w.put(kind, 2)
        if kind == webp.PALETTE:
            w.put(said[2] - 1, 8)
            put_image(w, said[1], said[2], rng)
        elif said:
            w.put(said[0] - 2, 3)
            put_image(w, said[1], said[2], rng)
        width = new
    w.put(0, 1)
    if meta:
        across, down = -(-width >> 2), -(-height >> 2)
        meta = (2, [k % 3 for k in range(across * down)])
    put_image(w, pixels, width, rng, True, cache_bits, meta)
    return webp._file([w.bytes()], height)


@pytest.mark.parametrize("kinds", [(), (webp.SUBTRACT_GREEN,), (webp.PREDICTOR,), (webp.CROSS_COLOUR,), (webp.PALETTE,), (webp.PREDICTOR, webp.CROSS_COLOUR, webp.SUBTRACT_GREEN), (webp.PALETTE, webp.PREDICTOR)])
def test_webp_features(kinds):
    rng = random.Random(repr(kinds))
    images, files = [], []
    for colours in (1, 2, 4, 13, 200, 4000):
        if webp.PALETTE in kinds and colours > 200:
            continue
        for cache_bits, meta in ((0, False), (4, False), (7, True)):
            width, height = rng.randrange(1, 30), rng.randrange(1, 24)
            some = [rng.randrange(1 << 32) for _ in range(colours)]
            pixels = [rng.choice(some) for _ in range(width * height)]
            for _ in range(6):  # stretches that repeat
                a, b, n = rng.randrange(len(pixels)), rng.randrange(len(pixels)), rng.randrange(40)
                pixels[b : b + n] = (pixels[a : a + n] + pixels[b : b + n])[: len(pixels[b : b + n])]
            images.append((width, height, pixels))
            files.append(file_of(pixels, width, height, kinds, cache_bits, meta, rng))
    for (width, height, pixels), frames in zip(images, webp.decode(files), strict=True):
        assert [(w, h) for w, h, _ in frames] == [(width, height)]
        assert frames[0][2].tolist() == pixels


def test_the_writer_picks_transforms():
    rng = np.random.default_rng(12)
    row = rng.integers(0, 256, 192).astype(np.uint8).tobytes()
    cases = {
        "palette of one": b" " * 192, "palette of two": b"".join((b"abc", b"xyz")[k] for k in rng.integers(0, 2, 64 * 9).tolist()), "palette of many": b"".join(bytes([k, k, 255 - k]) * 3 for k in rng.integers(0, 16, 64 * 20).tolist())[: 192 * 40],
        "predictor": row * 64 + rng.integers(0, 256, 192).astype(np.uint8).tobytes() + row * 100, "plain": rng.integers(97, 123, 192 * 70).astype(np.uint8).tobytes(), "both": b"\0" * 192 * 64 + row * 40,
    }
    files = webp.encode(list(cases.values()))
    for (name, payload), file, frames in zip(cases.items(), files, webp.decode(files), strict=True):
        argb = np.concatenate([f[2] for f in frames])
        assert (argb >> 24 == 255).all()
        assert np.stack([argb >> s & 255 for s in (16, 8, 0)], 1).astype(np.uint8).tobytes() == payload, name
    kinds = [{step[0] for _, body in webp.chunks(f) for step in webp.Image(body).steps} for f in files]
    assert kinds[:5] == [{webp.PALETTE}, {webp.PALETTE}, {webp.PALETTE}, {webp.PREDICTOR}, set()] and webp.PREDICTOR in kinds[5] and webp.PALETTE in kinds[5]
    assert webp.encode([cases["plain"], cases["predictor"]])[1] == files[3]  # the same beside others


def test_webp_round_trip_and_errors():
    rng = random.Random(4)
    payloads = [bytes(rng.choice((32, 97, rng.randrange(256))) for _ in range(192 * n)) for n in (1, 2, 63, 64, 65, 200)] + [b" " * 192 * 70, "日本語😀 ".encode() * 192]
    files = webp.encode(payloads)
    assert files == webp.encode(payloads) and [webp.encode([p])[0] for p in payloads] == files
    for p, frames in zip(payloads, webp.decode(files), strict=True):
        argb = np.concatenate([f[2] for f in frames])
        assert np.stack([argb >> s for s in (16, 8, 0)], -1).astype(np.uint8).tobytes() == p and (argb >> 24 == 255).all()
    with pytest.raises(ValueError):
        webp.decode([files[3][:400]])
    with pytest.raises(ValueError):
        webp.decode([b"RIFF\0\0\0\0WAVE"])


def test_html_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
    <nav><ul><li>Menu</li></ul></nav><div class="cookie-notice">We use cookies</div><aside>Side</aside>
    <article><header><h1>Title &amp; more</h1><p>by me</p></header><p>First <b>bold</b>,
      line&nbsp;two<br>three &lt;x&gt; &#233;</p><p>Second<script>var a = "</p>";</script> part<ul><li>one<li>two</ul>
    <div class="ad"><p>Buy</p></div><form><p>Mail <input></p></form><table><tr><td>a<td>b</table><section id="comments"><p>Nice</p></section><p>Last &amp tail</article>
    <footer>&copy; us</footer></body></html>"""
    want = ["Title & more", "First bold, line two three <x> é", "Second part", "one", "two", "a", "b", "Last & tail"]
    assert [t for _, t in html.Page(page).blocks] == want
    assert [t for _, t in html.Page("<p>no article<div>here").blocks] == ["no article", "here"]
    assert html.Page("").blocks == [] and [t for _, t in html.Page("a < b & c").blocks] == ["a < b & c"]
    assert [t for _, t in html.Page("<article><p>cut &am").blocks] == ["cut &am"]
    assert [t for _, t in html.Page("<article><p>cut<a href=\"x").blocks] == ["cut"]


@pytest.mark.parametrize("page, want", [
    ("<article><p>before</p><svg/><p>after</p><math xmlns='x'/>tail</article>", ["before", "after", "tail"]),
    ("<article><p>a</p><svg><text>no</text></svg><p>b</p><svg>open<p>c</p></article>", ["a", "b", "open", "c"]),
    ("<p title=it's>Don't</p><p title=it's>Hello</p><p title='a>b' x>c</p><p data-x=\"d>e\">f</p>", ["Don't", "Hello", "c", "f"]),
    ("<p>Press <button>OK</button> and <label>tick</label> it</p><div><button>Menu</button>text</div>", ["Press OK and tick it", "text"]),
    ('<article><div class="notice-board story"><p>one</p></div><div id="content-menu"><p>two</p></div><div class="share-buttons">x</div></article>', ["one", "two"]),
    ('<div class="layout has-sidebar"><div class="sidebar"><p>links</p></div><p>A text that is long enough</p></div>', ["A text that is long enough"]),
    ('<div class="widget"><p>All that the page has</p></div><p>rest</p>', ["All that the page has", "rest"]),
    ('<div class="overlay"><article><p>shown</p></article></div>', ["shown"]),
    ("<main><h1>Title</h1><article><p>body</p></article><p>after</p></main>", ["Title", "body"]),
    ("<p>a<select><option>x</select>b</p><p>c<i hidden>d</i>e</p>", ["ab", "ce"]),
    ('<p class="a" data-class="ad">kept</p><p data-hidden>too</p>', ["kept", "too"]),
])
def test_html_loses_nothing_else(page, want):
    assert [t for _, t in html.Page(page).blocks] == want


def brute_matching(tree, other, a=0, b=0):
    """Size of the largest matching that keeps parents and order, by trying all."""
    if tree[a][1] != other[b][1]:
        return 0
    left, right = ([k for k, (p, _) in enumerate(t) if p == n] for t, n in ((tree, a), (other, b)))

    def best(i, j):
        if i == len(left) or j == len(right):
            return 0
        w = brute_matching(tree, other, left[i], right[j])
        return max(best(i + 1, j), best(i, j + 1), w + best(i + 1, j + 1) if w else 0)

    return 1 + best(0, 0)


def test_alignment_is_a_largest_matching():
    rng = np.random.default_rng(8)

    def random_tree():
        tree = [(-1, "page")]
        for _ in range(rng.integers(1, 9)):
            tree.append((int(rng.integers(0, len(tree))), "ab"[rng.integers(0, 2)]))
        kids = lambda n: [k for k, (p, _) in enumerate(tree) if p == n]
        order = []
        waiting = [0]
        while waiting:  # in the order of beginnings
            order.append(n := waiting.pop())
            waiting.extend(reversed(kids(n)))
        place = {n: k for k, n in enumerate(order)}
        return [(place.get(tree[n][0], -1), tree[n][1]) for n in order]

    for _ in range(300):
        a, b = random_tree(), random_tree()
        matched = html.align(a, b)
        assert len(matched) == brute_matching(a, b)
        assert all(a[x][1] == b[y][1] and (x == 0 or matched[a[x][0]] == b[y][0]) for x, y in matched.items())
        assert [matched[x] for x in sorted(matched)] == sorted(matched.values())


def test_alignment_of_long_lists():
    page = lambda n, odd: html.Page("<body><p>top</p>" + "".join(f"<p>item {k if k % 3 else f'{odd}{k}'}</p>" for k in range(n)) + "<p>end</p></body>")
    one, two = page(12_000, "x"), page(9_000, "y")
    texts = [{n: hash(t) for n, t in p.blocks} for p in (one, two)]
    began = time.time()
    matched = html.align(one.tree, two.tree, tuple(texts))
    assert time.time() - began < 20
    assert matched[one.blocks[0][0]] == two.blocks[0][0] and matched[one.blocks[-1][0]] == two.blocks[-1][0]
    assert sum(texts[0][n] == texts[1].get(m) for n, m in matched.items() if n in texts[0]) == 6_002


def test_pages_without_an_article_change_nothing(spark):
    body = lambda k: f"<body><p>Read our rules</p><p>Story {k} tells {'more ' * k}</p>{'<p>further</p>' * (k % 3)}<p>Posted by staff</p></body>"
    rows = [(k, f"http://a.example/{k}", body(k)) for k in range(1, 11)]
    odd = [(100, "http://a.example/e", None), (101, "http://a.example/f", ""), (102, "http://a.example/g", "<p>404</p>"), (103, "http://a.example/h", "<body><h1>Error 500</h1></body>"), (104, "http://a.example/i", "<article></article>")]
    few = [(200 + k, "http://b.example/x", body(k)) for k in range(1, 4)]
    read = lambda given: {r.page_id: r.text for r in html.main_text(spark.createDataFrame(given, "page_id long, url string, html string")).collect()}
    plain, more = read(rows), read(rows + odd + few)
    assert {k: more[k] for k in plain} == plain and all("rules" not in t and "staff" not in t and "Story" in t for t in plain.values())
    assert [more[k] for k in range(100, 105)] == ["", "", "404", "Error 500", ""]
    assert all("rules" not in more[200 + k] and f"Story {k}" in more[200 + k] for k in range(1, 4))


def test_simple_tree_matching():
    tree = lambda *nodes: [(-1, "page"), *nodes]
    a = tree((0, "div"), (1, "#"), (0, "p"), (3, "#"), (0, "ul"), (5, "li"), (6, "#"), (5, "li"), (8, "#"))
    b = tree((0, "p"), (1, "#"), (0, "ul"), (3, "li"), (4, "#"))
    assert html.align(b, a) == {0: 0, 1: 3, 2: 4, 3: 5, 4: 8, 5: 9} or html.align(b, a) == {0: 0, 1: 3, 2: 4, 3: 5, 4: 6, 5: 7}
    assert html.align(a, a) == {k: k for k in range(len(a))}


def test_html_wrapper(spark):
    body = lambda k: f"<html><body><main><p>Read our rules</p><p>Story number {k} tells {'more ' * k}</p>{'<p>extra</p>' if k == 3 else ''}<p>Posted by staff</p></main></body></html>"
    rows = [(k, f"http://a.example/{k}", body(k), "h", 1) for k in range(1, 9)] + [(20, "http://b.example/x", body(1), "h", 1), (21, None, None, None, None), (22, "no url", "", "h", 1), (23, "http://a.example/1", body(1), "h", 1), (24, "http://a.example/l", "<article>" + "<p>long</p>" * 3000, "h", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, `row` int")
    got = {r.page_id: r for r in html.main_text(df).collect()}
    assert len(got) == len(rows)
    for k in range(1, 9):
        assert got[k].text == f"Story number {k} tells {'more ' * k}".strip() + ("\n\nextra" if k == 3 else "") and got[k].n_template == 2
        assert got[k].n_chars == len(got[k].text)
    assert got[20].text.startswith("Read our rules") and got[21].text == got[22].text == "" and got[23].text == got[1].text
    assert got[24].text.count("long") == 3000
    assert html.main_text(df.where("false")).count() == 0


def brute_top(rows, k=5):
    fine = []
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            fine.append((i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)))
    lengths = [len(v) for _, v in fine]
    usual = min(set(lengths), key=lambda n: (-lengths.count(n), n))
    fine = [(i, v) for i, v in fine if len(v) == usual]
    out = []
    for a, (q, v) in enumerate(fine):
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for b, (i, w) in enumerate(fine) if a != b)[:k]
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("case", ["random", "few", "same"])
def test_top_k(spark, case):
    rng = np.random.default_rng(2)
    if case == "random":
        centres = rng.normal(size=(6, 12))
        rows = [(i, (centres[i % 6] * (i % 4 + 1) + rng.normal(size=12) * 0.3).tolist()) for i in range(1500)]
        rows += [(2000 + i, rows[7][1]) for i in range(60)] + [(3001, None), (None, [1.0] * 12), (3002, [None] + [1.0] * 11), (3003, [float("nan")] * 12), (3000, [float("inf")] * 12), (7, rows[7][1])]
        rows += [(50, rows[50][1]), (50, rows[50][1]), (100, rows[3][1]), (3050, [1.0, 2.0]), (3051, [9.0] * 13)]  # repeats, one id twice, other lengths
    elif case == "few":
        rows = [(0, [1.0, -2.0]), (1, [0.5, 0.5]), (50, [-1.0, 0.001])]
    else:
        rows = [(i, [0.25, 0.5, -0.75]) for i in range(200)]
    df = spark.createDataFrame([(i, v, 1, 2, 3.0) for i, v in rows], "vec_id long, embedding array<double>, id int, v int, score double")
    got = mtree.top_k(df, "pmod(vec_id, 50) = 0")
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows)


def test_top_k_fails_rather_than_lose_digits(spark):
    df = spark.createDataFrame([(0, [1e9, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        mtree.top_k(df, "pmod(vec_id, 50) = 0")


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert mtree.top_k(df, "pmod(vec_id, 50) = 0").count() == 0
    assert mtree.top_k(df.where("false"), "pmod(vec_id, 50) = 0").count() == 0


def test_mtree_pages_cover_their_vectors():
    rng = np.random.default_rng(1)
    x = np.column_stack((rng.integers(-300, 300, (3000, 5)).astype(float), np.zeros(3000)))
    pages = mtree.build(x)

    def rows(k):
        page = pages[k]
        return list(page["child"]) if page["leaf"] else [r for c in page["child"] for r in rows(c)]

    assert sorted(rows(0)) == list(range(3000)) and len(pages) > 12
    for page in pages:
        assert len(page["entries"]) <= max(mtree.PAGE, mtree.FANOUT)
        for k in range(len(page["child"])) if not page["leaf"] else ():
            inside = x[rows(page["child"][k])]
            assert mtree.distances(inside, page["entries"][k : k + 1]).max() <= page["radius"][k] * (1 + 1e-9)


def text_of(html):
    from trackweave.llm.html import Page

    return "\n\n".join(t for _, t in Page(html).blocks)


#: Layouts that are common on the web, and their articles.
LAYOUTS = {
    "comments as articles beside the article's text": ('<main><h1>Title</h1><p>article</p><section id="comments"><article class="comment"><p>Reader 0 says hi at length</p></article></section></main>', "Title\n\narticle"),
    "comments as articles inside the article": ('<article><h1>Title</h1><p>article text</p><div id="comments"><article class="comment-body"><p>Reader says a lot more than this</p></article></div></article>', "Title\n\narticle text"),
    "comments by their names": ('<div><p>The text of it.</p><div class="user-comments"><p>No, it is not so, and here is why</p></div><div class="reader-comments">so</div><div id="comment-42">and so</div></div>', "The text of it."),
    "adverts and notices by their names": ('<div><p>The text of it, which is long enough.</p><div class="advert-top-728x90">Buy</div><div class="cookieNotice">We bake</div></div>', "The text of it, which is long enough."),
    "a lead in the header": ('<article><header><p class="lead">What it is about.</p></header><p>Then it goes on.</p></article>', "What it is about.\n\nThen it goes on."),
    "a byline in the header": ('<article><header><h1>Title</h1></header><p>Text.</p><footer>by A</footer></article>', "Title\n\nText."),
    "paragraphs with names": ('<article><p class="skip">One.</p><p id="reply">Two.</p><h2 class="share">Three</h2></article>', "One.\n\nTwo.\n\nThree"),
    "teasers in a sidebar": ('<article><h1>T</h1><p>Text</p></article><div class="related-posts"><article><h2>Other</h2><p>One</p></article></div>', "T\n\nText"),
    "a list of articles": ("<main><article><h2>A</h2><p>a</p></article><article><h2>B</h2><p>b</p></article></main>", "A\n\na\n\nB\n\nb"),
    "quotes inside the article": ("<article><p>It says</p><blockquote>so</blockquote></article>", "It says\n\nso"),
    "only comments": ('<div class="comments"><p>alone</p></div>', "alone"),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_common_layouts(name):
    html, want = LAYOUTS[name]
    assert text_of(html) == want


def test_deep_pages_take_time_in_proportion():
    import time

    for html in ("<div>" * 100_000 + "x", "".join(f"<div>w{i} " for i in range(30_000)), "<svg>" * 100_000, "<p>a</div>" * 50_000, "<li>x" * 50_000, "<span></b>" * 50_000, '<div class="ad">' * 30_000 + "x", "<title>" * 50_000):
        began = time.thread_time()
        text_of(html)
        assert time.thread_time() - began < 4, html[:20]


def test_alignment_does_not_depend_on_the_size_of_its_table(monkeypatch):
    """weights and pairs are the same however few cells may be kept, and those of the whole table."""
    import numpy as np

    from trackweave.llm import html

    rng = np.random.default_rng(1)

    def shapes(m):
        # Shape 0 and 1 are leaves, 2 and 3 lists of them that share an order only in part.
        return [(0,), (1,), (2, *rng.integers(0, 2, m).tolist()), (2, *rng.integers(0, 2, m).tolist())]

    for m in (1, 2, 7, 40):
        parts, rows = shapes(m), rng.integers(0, 4, (m, m + 3)).astype(np.int32)
        got = []
        for cells in (1, 50, 1_000_000):
            monkeypatch.setattr(html, "CELLS", cells)
            matching = html._Matching()
            matching.parts = parts
            got.append((matching.weight(2, 3), list(html._matches(lambda i: rows[i], m, m + 3))))
        assert got[0] == got[1] == got[2]
        table = list(html._table(rows, np.zeros(m + 4, np.int32)))
        assert sum(int(rows[i, j]) for i, j in got[0][1]) == table[-1][-1]
        left, right = parts[2][1:], parts[3][1:]
        best = np.zeros((m + 1, m + 1), int)
        for i in range(m):
            for j in range(m):
                best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + (left[i] == right[j]))
        assert got[0][0] == 1 + best[-1, -1]
