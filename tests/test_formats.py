"""Names, tar, codecs, tensors, images, openers: plain Python, small vectors and seeded fuzz."""

import gzip
import io
import random
import tarfile

import numpy as np
import pytest

from sparkshards.functions import codecs, images, names, tensors
from sparkshards.functions.errors import DecodeError, DuplicateKey, EncodeError, FormatError, MissingKey, OnError, SecurityError, ShardError, SubprocessError, Unsupported, ValueProblem
from sparkshards.sources import opener, tario


# -- names -------------------------------------------------------------------------


def _grown(rng, depth):
    """A random pattern, and what it stands for by a plain product of its parts."""
    parts = []
    for _ in range(rng.randrange(1, 4)):
        kind = rng.randrange(6 if depth else 4)
        if kind == 0:
            text = "".join(rng.choice("mnop-_/.") for _ in range(rng.randrange(1, 4)))
            parts.append((text, [text]))
        elif kind == 1:
            lo, hi, step, width = rng.randrange(-3, 20), rng.randrange(-3, 20), rng.randrange(1, 5), rng.choice([1, 4])
            both = [f"{x:0{width}d}" for x in (lo, hi)]
            wide = max(map(len, both)) if any(x.lstrip("-").startswith("0") and len(x.lstrip("-")) > 1 for x in both) else 0
            parts.append((f"{{{both[0]}..{both[1]}..{step}}}", [f"{v:0{wide}d}" for v in range(lo, hi + (1 if lo <= hi else -1), step if lo <= hi else -step)]))
        elif kind == 2:
            lo, hi = rng.choice("cdefgh"), rng.choice("cdefgh")
            way = 1 if lo <= hi else -1
            parts.append((f"{{{lo}..{hi}}}", [chr(c) for c in range(ord(lo), ord(hi) + way, way)]))
        elif kind == 3:
            parts.append(("\\{q\\}", ["{q}"]))
        else:
            inner = [_grown(rng, depth - 1) for _ in range(rng.randrange(2, 4))]
            parts.append(("{" + ",".join(p for p, _ in inner) + "}", [x for _, xs in inner for x in xs]))
    out = [""]
    for _, xs in parts:
        out = [a + b for a in out for b in xs]
    return "".join(p for p, _ in parts), out


def test_braces():
    rng = random.Random(31)
    for _ in range(300):
        pattern, expected = _grown(rng, 2)
        assert names.brace_expand(pattern) == expected, pattern
    assert names.brace_expand("no{thing}here") == ["no{thing}here"] and names.brace_expand("w{,v}") == ["w", "wv"]


@pytest.mark.parametrize("pattern", ["{a", "a}", "{a,{b}"])
def test_unbalanced_braces(pattern):
    with pytest.raises(FormatError):
        names.brace_expand(pattern)


def test_urls_and_variables():
    env = {names.ENV_PREFIX + "ROOT": "/d/${SUB}", names.ENV_PREFIX + "SUB": "x"}
    assert names.expand_urls("${ROOT}/a-{0..1}.tar::b.tar", env) == ["/d/x/a-0.tar", "/d/x/a-1.tar", "b.tar"]
    with pytest.raises(MissingKey):
        names.env_subst("${NONE}", env)
    assert names.env_subst("${not a name}", env) == "${not a name}"


def test_base_plus_ext():
    rng = random.Random(8)
    for _ in range(500):
        path = "".join(rng.choice("uv./_") for _ in range(rng.randrange(0, 9)))
        folder, slash, name = path.rpartition("/")
        base, dot, ext = name.partition(".")
        assert names.base_plus_ext(path) == ((folder + slash + base, ext) if dot and base else None), path


def test_shard_metadata():
    rng = random.Random(9)
    for _ in range(2000):
        path = "".join(rng.choice(["_", "__", "z", "/", "."]) for _ in range(rng.randrange(0, 6)))
        top = path.split("/")[0]
        inner = top[2:-2]
        # two marks around something, in which there is no other mark and none begins
        want = len(top) > 4 and top[:2] == top[-2:] == "__" and "__" not in inner + "_"
        assert names.is_shard_metadata(path) == want, path


def test_shard_patterns():
    for n in (0, 3, 12, 4567, 10**7):
        for width in (0, 2, 5):
            mark = f"%0{width}d" if width else "%i"
            assert names.format_shard_pattern(f"out/{mark}.t", n) == f"out/{str(n).rjust(width, '0')}.t"
    assert names.format_shard_pattern("%d%%", 9) == "9%"
    for bad in ("%x", "fixed", "%%", "end%"):
        with pytest.raises(FormatError):
            names.format_shard_pattern(bad, 1)


def test_seeds_and_words():
    assert names.seed_from_str("") == 0xCBF29CE484222325 and names.make_seed(1, 2) != names.make_seed(2, 1)
    assert names.human_bytes(999) == "999 B" and names.human_bytes(1500) == "1.5 kB" and names.shorten("abcdefgh", 6) == "...fgh"
    assert [names.choose_weighted([1, 0, 3], u) for u in (0.1, 0.3, 0.999)] == [0, 2, 2]
    with pytest.raises(ValueProblem):
        names.choose_weighted([0, 0], 0.5)


# -- tar -----------------------------------------------------------------------------


def archive(found, form=tarfile.USTAR_FORMAT):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=form) as t:
        for name, data in found:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


@pytest.mark.parametrize("form", [tarfile.USTAR_FORMAT, tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
def test_members_of_every_size(form):
    found = [(f"a{n}.bin", bytes(n % 251 for _ in range(n))) for n in (0, 1, 511, 512, 513, 1024, 4096)] + [("d/" * 40 + "x.txt", b"deep")]
    if form != tarfile.USTAR_FORMAT:
        found.append(("n" * 300 + ".txt", b"long"))
    assert list(tario.members(io.BytesIO(archive(found, form)))) == found


def test_other_member_types_and_a_missing_end():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        folder = tarfile.TarInfo("d")
        folder.type = tarfile.DIRTYPE
        t.addfile(folder)
        link = tarfile.TarInfo("l.txt")
        link.type, link.linkname = tarfile.SYMTYPE, "x"
        t.addfile(link)
        info = tarfile.TarInfo("f.txt")
        info.size = 2
        t.addfile(info, io.BytesIO(b"ok"))
    assert list(tario.members(io.BytesIO(out.getvalue()))) == [("f.txt", b"ok")]
    whole = archive([("a.txt", b"abc")])
    assert list(tario.members(io.BytesIO(whole[:1024]))) == [("a.txt", b"abc")]
    for cut in (100, 513, 516, 700):
        with pytest.raises(FormatError):
            list(tario.members(io.BytesIO(whole[:cut])))


def test_grouping_is_by_runs():
    found = [("k1.A", b"1"), ("k1.b", b"2"), ("noext", b""), ("k1.c", b"3"), ("k2.a", b"4"), ("k1.a", b"5"), ("k1.a", b"6"), ("__meta__/x.y", b"")]
    got = list(tario.group(tario.Selection().apply(found)))
    assert [(x.key, x.fields) for x in got if isinstance(x, tario.Sample)] == [("k1", {"a": b"1", "b": b"2", "c": b"3"}), ("k2", {"a": b"4"}), ("k1", {"a": b"5"})]
    assert [type(x.error) for x in got if isinstance(x, tario.Problem)] == [DuplicateKey]
    chosen = tario.Selection(lambda n: n.endswith("image"), lambda n: n.replace(".png", ".image"))
    assert [x.fields for x in tario.group(chosen.apply([("a.png", b"1"), ("a.cls", b"2")]))] == [{"image": b"1"}]


def test_policies_on_a_cut_archive():
    data = archive([("a.x", b"1" * 600), ("a.y", b"2"), ("b.x", b"3" * 600)])[:3700]
    with pytest.raises(FormatError):
        list(tario.read_samples(io.BytesIO(data)))
    for policy in (OnError.CONTINUE, OnError.STOP):
        assert [s.key for s in tario.read_samples(io.BytesIO(data), policy=policy)] == ["a"]


@pytest.mark.parametrize("name", ["a.tar", "a.tar.gz", "a.tgz", "a.tar.zst", "a.tar.bz2", "a.tar.xz"])
def test_writer_and_reader_agree(name):
    sink = io.BytesIO()
    writer = tario.TarWriter(sink, name)
    sizes = [writer.write(k, {"txt": "é", "_skip": "x", "bin": bytes(n), "none": None}) for k, n in (("a", 0), ("d/" * 60 + "b", 700), ("c" * 200, 3))]
    writer.close()
    assert sizes == [2, 702, 5]
    assert [(s.key, s.fields) for s in tario.read_samples(io.BytesIO(sink.getvalue()))] == [(k, {"bin": bytes(n), "txt": "é".encode()}) for k, n in (("a", 0), ("d/" * 60 + "b", 700), ("c" * 200, 3))]
    if name == "a.tar":
        with tarfile.open(fileobj=io.BytesIO(sink.getvalue())) as t:
            assert [(m.mode, m.uname, m.size) for m in t][0] == (0o444, "bigdata", 0)
    with pytest.raises(MissingKey):
        writer.write(None, {})
    with pytest.raises(EncodeError):
        tario.TarWriter(io.BytesIO()).write("k", {"a": 3})


def test_shard_writer(tmp_path):
    seen = []
    with tario.ShardWriter(str(tmp_path / "s-%03d.tar"), max_count=3, max_size=25, start_shard=5, post=seen.append) as w:
        for i in range(7):
            w.write(f"k{i}", {"txt": "x" * (5 if i < 4 else 30)})
    assert [p.rsplit("/", 1)[1] for p in seen] == ["s-005.tar", "s-006.tar", "s-007.tar", "s-008.tar"]
    keys = [[s.key for s in tario.read_samples(open(p, "rb"))] for p in seen]
    assert keys == [["k0", "k1", "k2"], ["k3", "k4"], ["k5"], ["k6"]]
    with pytest.raises(EncodeError), tario.ShardWriter(str(tmp_path / "t-%d.tar")) as w:
        w.write("k", {"a": 1})
    assert sorted(p.name for p in tmp_path.iterdir()) == [f"s-{i:03d}.tar" for i in range(5, 9)]


def test_public_names_and_workers():
    import sparkshards

    assert all(getattr(sparkshards, n) is not None for n in sparkshards.__all__)
    assert names.worker_info({"RANK": "1", "WORLD_SIZE": "2"}) == names.WorkerInfo(1, 2)
    with pytest.raises(ValueProblem):
        names.worker_info({"RANK": "2", "WORLD_SIZE": "2"})


def test_damaged_archives_raise_only_our_errors():
    rng, good = random.Random(0), archive([("a.x", b"1" * 700), ("b.y", b"2" * 10)], tarfile.PAX_FORMAT)
    for n in range(600):
        data = bytearray(good if n % 3 else rng.randbytes(2048))
        for _ in range(rng.randrange(1, 8)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        if n % 2:  # a checksum that fits the damage
            data[148:156] = b" " * 8
            data[148:156] = b"%06o\0 " % sum(data[:512])
        try:
            list(tario.read_samples(io.BytesIO(bytes(data[: rng.randrange(1, len(data) + 1)]))))
        except (ShardError, OSError, EOFError):
            pass


# -- codecs, tensors, images -----------------------------------------------------------

VALUES = [None, True, False, 0, 127, 128, -1, -32, -33, 255, 256, 65535, 65536, 2**32, -(2**31) - 1, 2**63 - 1, -(2**63), 1.5, "", "é" * 40, [], [1, [2]], {"a": {"b": None}}, list(range(20)), {str(i): i for i in range(20)}, "x" * 70_000]


def test_msgpack_and_cbor_round_trip():
    for pack, unpack in ((codecs.pack_msgpack, codecs.unpack_msgpack), (codecs.pack_cbor, codecs.unpack_cbor)):
        for v in VALUES:
            assert unpack(pack(v)) == v
        with pytest.raises(DecodeError):
            unpack(pack([1, 2, 3])[:-1])
        with pytest.raises(DecodeError):
            unpack(b"")
        with pytest.raises(EncodeError):
            pack({1, 2})
    assert codecs.unpack_cbor(bytes.fromhex("9f01820203ff")) == [1, [2, 3]]
    assert codecs.unpack_cbor(bytes.fromhex("f93c00")) == 1.0 and codecs.unpack_cbor(bytes.fromhex("c11a514b67b0")) == 1363896240
    assert codecs.jsonable({"b": float("nan"), "a": 2**64}) == {"a": float(2**64), "b": None}


def test_npy_npz_tenbin_round_trip():
    rng = np.random.default_rng(0)
    arrays = [rng.integers(0, 100, s).astype(k) for k in ("f2", "f4", "f8", "i1", "i8", "u1", "u2", "u4", "u8") for s in ((), (3,), (2, 3), (0, 4))]
    for a in arrays:
        b = tensors.read_npy(tensors.write_npy(a))
        assert b.dtype == a.dtype and b.shape == a.shape and (a == b).all()
        assert (np.load(io.BytesIO(tensors.write_npy(a))) == a).all()
        assert len(tensors.write_npy(a).split(b"\n")[0]) % 64 == 63
    out = tensors.read_tenbin(tensors.write_tenbin(arrays))
    assert all(a.shape == b.shape and (a == b).all() for a, b in zip(arrays, out))
    assert tensors.read_tenbin_labelled(tensors.write_tenbin([tensors.Labelled(arrays[1], "lab")]))[0].label == "lab"
    back = tensors.read_npz(tensors.write_npz({"v": arrays[1], "w": arrays[2]}))
    assert sorted(back) == ["v", "w"] and (back["w"] == arrays[2]).all()
    big = io.BytesIO()
    np.save(big, np.arange(4, dtype=">i4"))
    assert tensors.read_npy(big.getvalue()).tolist() == [0, 1, 2, 3]
    fortran = io.BytesIO()
    np.save(fortran, np.asfortranarray(np.ones((2, 3))))
    with pytest.raises(Unsupported):
        tensors.read_npy(fortran.getvalue())
    for bad in (b"", b"\x93NUMPY\x01\x00\xff\xff{", tensors.write_npy(arrays[5])[:-1]):
        with pytest.raises(ShardError):
            tensors.read_npy(bad)
    with pytest.raises(EncodeError):
        tensors.write_tenbin([np.zeros((1,) * 10, "f4")])


def test_damaged_tenbin_raises_only_our_errors():
    rng, good = random.Random(1), tensors.write_tenbin([np.ones((2, 3), "f4")])
    for _ in range(500):
        data = bytearray(good)
        for _ in range(rng.randrange(1, 5)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        try:
            tensors.read_tenbin(bytes(data[: rng.randrange(len(data) + 1)]))
        except ShardError:
            pass


def test_images():
    rng = np.random.default_rng(0)
    for channels in (1, 3, 4):
        a = rng.integers(0, 256, (7, 5, channels), dtype=np.uint8)
        assert (images.read_png(images.write_png(a)) == a).all()
        if channels < 4:
            assert (images.read_pnm(images.write_pnm(a)) == a).all()
    rgb = rng.integers(0, 256, (4, 6, 3), dtype=np.uint8)
    assert (images.read_bmp(images.write_bmp(rgb)) == rgb).all()
    assert images.to_value(rgb, "torchrgb").shape == (3, 4, 6) and images.to_value(rgb, "L8").shape == (4, 6) and images.to_value(rgb, "rgba8")[0, 0, 3] == 255
    assert np.allclose(images.to_value(rgb, "rgb") * 255, rgb)
    assert images.luma(np.full((1, 1, 3), 255, np.uint8))[0, 0] == 255
    assert (images.read_png(images.write_image(rgb.astype(np.float32) / 255, "png")) == rgb).all()
    with pytest.raises(EncodeError):
        images.write_image(np.full((2, 2), 1.5), "png")
    with pytest.raises(Unsupported):
        images.write_image(rgb, "webp")
    with pytest.raises(Unsupported):
        images.spec("nothing")


def test_png_filters():
    """Each filter by hand, against plain rows."""
    import struct
    import zlib

    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (5, 4, 3), dtype=np.uint8).astype(int)
    lines = []
    for y in range(5):
        kind, row = y, a[y].reshape(-1)
        up = a[y - 1].reshape(-1) if y else np.zeros(12, int)
        left, corner = np.concatenate([np.zeros(3, int), row[:-3]]), np.concatenate([np.zeros(3, int), up[:-3]])
        p = left + up - corner
        near = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = [np.zeros(12, int), left, up, (left + up) // 2, near][kind]
        lines.append(bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes())
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
    assert (images.read_png(data) == a).all()


# -- openers ---------------------------------------------------------------------------


def test_urls():
    assert opener.scheme("S3a://b/k") == "s3a" and opener.scheme("/a:b") is None and opener.is_local("file:///x")
    assert opener.to_local_path("file:///a%20b") == "/a b" and opener.to_local_path("http://x") is None
    assert opener.rewrite_url("gs://a/b", "s3:=x;gs://=http://h/") == "http://h/a/b"
    assert opener.resolve_hub_url("hf://datasets/o/n@v1/p/q.tar") == "https://huggingface.co/datasets/o/n/resolve/v1/p/q.tar"
    assert opener.url_to_cache_name("http://a/x/y.tar") != opener.url_to_cache_name("http://b/x/y.tar")


def test_opening(tmp_path):
    path = tmp_path / "a.bin"
    with opener.gopen(str(path), "wb") as f:
        f.write(b"data")
    assert opener.gopen(f"file://{path}").read() == b"data"
    with pytest.raises(SecurityError):
        opener.gopen(str(path), secure=True)
    with pytest.raises(SecurityError):
        opener.gopen("pipe:true")
    assert opener.gopen("pipe:printf abc", allow_pipe=True).read() == b"abc"
    with pytest.raises(SubprocessError):
        opener.gopen("pipe:exit 3", allow_pipe=True).read()
    opener.register_scheme("mem", lambda url, mode: io.BytesIO(url.encode()))
    assert opener.gopen("mem:x").read() == b"mem:x" and "mem" in opener.schemes()


def test_cache(tmp_path):
    calls = []
    data = gzip.compress(archive([("a.x", b"1")]))

    def fetch(url, mode):
        calls.append(url)
        return io.BytesIO(b"junk" if "bad" in url else data)

    held = opener.Opener(handlers={"far": fetch}, cache_dir=str(tmp_path), cache_bytes=1)
    for _ in range(2):
        assert held.open("far://h/a.tgz").read() == data
    assert calls == ["far://h/a.tgz"]
    with pytest.raises(FormatError):
        held.open("far://h/bad.tgz")


# -- JPEG, GIF, PNG forms -----------------------------------------------------------------


def _picture(rng, height, width, channels):
    """Smooth, with some edges."""
    y, x = np.mgrid[0:height, 0:width]
    a = np.stack([127 + 100 * np.sin(x / rng.uniform(5, 20) + y / rng.uniform(5, 20) + k) for k in range(channels)], axis=2)
    a[height // 3 : height // 2, width // 4 : width // 2] = rng.integers(0, 256, channels)
    return a.clip(0, 255).astype(np.uint8)


def test_jpeg_round_trip():
    from sparkshards.functions import images, jpeg

    rng = np.random.default_rng(2)
    for height, width, channels in ((1, 1, 3), (8, 8, 1), (61, 75, 3), (64, 64, 3), (17, 130, 1)):
        a = _picture(rng, height, width, channels)
        for quality, most in ((100, 1), (85, 4), (30, 15)):
            back = images.read_image(jpeg.write_jpeg(a, quality))
            assert back.shape == a.shape and np.abs(back.astype(int) - a).mean() <= most
    # many at once, of several geometries, some damaged
    made = [jpeg.write_jpeg(_picture(rng, *shape), 85) for shape in [(40, 40, 3)] * 9 + [(16, 30, 1)] * 3]
    made[4], made[10] = made[4][:700], b"\xff\xd8\xff"
    for i, found in enumerate(images.read_images([*made, None])):
        if i in (4, 10):
            assert isinstance(found, DecodeError)
        elif i < len(made):
            assert (found == jpeg.read_jpeg(made[i])).all()
    data = jpeg.write_jpeg(_picture(rng, 40, 40, 3))
    for broken in (data[:2], data[:40], data[: len(data) // 2], data[:200] + b"\xff\xd9"):
        with pytest.raises(Exception, match="JPEG"):
            jpeg.read_jpeg(broken)


def test_jpeg_agrees_with_the_platform(spark):
    """Pictures written by the Java runtime, baseline and progressive, with halved colours."""
    from sparkshards.functions import images

    jvm, rng = spark._jvm, np.random.default_rng(4)
    for height, width in ((64, 64), (33, 70)):
        a = _picture(rng, height, width, 3)
        picture = jvm.java.awt.image.BufferedImage(width, height, 1)
        flat = (a[..., 0].astype(int) << 16 | a[..., 1].astype(int) << 8 | a[..., 2]).reshape(-1).tolist()
        held = spark.sparkContext._gateway.new_array(jvm.int, len(flat))
        for i, v in enumerate(flat):
            held[i] = v
        picture.setRGB(0, 0, width, height, held, 0, width)
        for progressive in (False, True):
            writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
            how = writer.getDefaultWriteParam()
            if progressive:
                how.setProgressiveMode(1)
            sink = jvm.java.io.ByteArrayOutputStream()
            writer.setOutput(jvm.javax.imageio.ImageIO.createImageOutputStream(sink))
            writer.write(None, jvm.javax.imageio.IIOImage(picture, None, None), how)
            writer.getOutput().flush()
            data = bytes(sink.toByteArray())
            read = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(sink.toByteArray()))
            want = np.array([read.getRGB(x, y) & 0xFFFFFF for y in range(height) for x in range(width)])
            want = np.stack([want >> 16, want >> 8 & 255, want & 255], axis=1).reshape(height, width, 3)
            got = images.read_image(data).astype(int)
            assert got.shape == want.shape and np.abs(got - want).max() <= 4 and np.abs(got - want).mean() < 0.5


def _png(a, depth, color, interlaced=False):
    """A PNG of samples, without filters, made by hand."""
    import struct
    import zlib

    from sparkshards.functions.images import _passes

    def rows(part):
        if depth == 16:
            return part.astype(">u2").reshape(len(part), -1).view(np.uint8)
        bits = (part.reshape(len(part), -1)[..., None] >> np.arange(depth - 1, -1, -1)) & 1
        return np.packbits(bits.reshape(len(part), -1).astype(np.uint8), axis=1)

    height, width = a.shape[:2]
    body = b"".join(b"\0" + r.tobytes() for x, y, dx, dy in (_passes(width, height) if interlaced else [(0, 0, 1, 1)]) for r in rows(a[y::dy, x::dx]))
    chunk = lambda kind, part: struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))
    palette = chunk(b"PLTE", bytes(range(96))) if color == 3 else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, int(interlaced))) + palette + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def test_png_depths_and_interlacing():
    from sparkshards.functions.images import read_png

    rng = np.random.default_rng(6)
    for height, width in ((1, 1), (5, 3), (8, 8), (13, 29)):
        for interlaced in (False, True):
            for depth in (1, 2, 4, 8):
                a = rng.integers(0, 1 << depth, (height, width, 1))
                assert (read_png(_png(a, depth, 0, interlaced)) == a * (255 // ((1 << depth) - 1))).all()
            a = rng.integers(0, 1 << 16, (height, width, 3))
            assert (read_png(_png(a, 16, 2, interlaced)) == a >> 8).all()
            a = rng.integers(0, 32, (height, width, 1))
            assert (read_png(_png(a, 8, 3, interlaced))[..., 0] == 3 * a[..., 0]).all()


def test_gif(spark):
    """Written by the Java runtime."""
    from sparkshards.functions.images import read_image

    jvm = spark._jvm
    picture = jvm.java.awt.image.BufferedImage(40, 30, 1)
    colours = [0xFF0000, 0x00FF00, 0x0000FF, 0x102030, 0xFFFFFF]
    want = np.zeros((30, 40), int)
    for y in range(30):
        for x in range(40):
            want[y, x] = colours[(x * y // 7 + x) % 5]
            picture.setRGB(x, y, int(want[y, x]))
    sink = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(picture, "gif", sink)
    got = read_image(bytes(sink.toByteArray())).astype(int)
    assert ((got[..., 0] << 16 | got[..., 1] << 8 | got[..., 2]) == want).all()
    with pytest.raises(Exception, match="GIF"):
        read_image(bytes(sink.toByteArray())[:60])
