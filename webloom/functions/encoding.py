"""Character encodings and media types of byte strings.

The plain functions work on one value; those that end in ``_of`` wrap them for columns.  A null
gives null.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of the WHATWG encoding standard by Python codec
_LABELS = {
    "utf-8": "utf8 utf-8 unicode-1-1-utf-8 unicode11utf8 unicode20utf8 x-unicode20utf8",
    "utf-16-be": "utf-16be utf-16-be unicodefffe",
    "utf-16-le": "utf-16le utf-16-le utf-16 ucs-2 unicode unicodefeff csunicode iso-10646-ucs-2",
    "cp866": "cp866 866 ibm866 csibm866",
    "iso8859-2": "latin2 l2 iso8859-2 iso-8859-2 iso_8859-2 iso88592 iso_8859-2:1987 iso-ir-101 csisolatin2",
    "iso8859-3": "latin3 l3 iso8859-3 iso-8859-3 iso_8859-3 iso88593 iso_8859-3:1988 iso-ir-109 csisolatin3",
    "iso8859-4": "latin4 l4 iso8859-4 iso-8859-4 iso_8859-4 iso88594 iso_8859-4:1988 iso-ir-110 csisolatin4",
    "iso8859-5": "cyrillic iso8859-5 iso-8859-5 iso_8859-5 iso88595 iso_8859-5:1988 iso-ir-144 csisolatincyrillic",
    "iso8859-6": "arabic asmo-708 ecma-114 iso8859-6 iso-8859-6 iso_8859-6 iso88596 iso_8859-6:1987 iso-8859-6-e iso-8859-6-i csiso88596e csiso88596i iso-ir-127 csisolatinarabic",
    "iso8859-7": "greek greek8 elot_928 ecma-118 sun_eu_greek iso8859-7 iso-8859-7 iso_8859-7 iso88597 iso_8859-7:1987 iso-ir-126 csisolatingreek",
    "iso8859-8": "hebrew visual logical iso8859-8 iso_8859-8 iso88598 iso_8859-8:1988 iso-8859-8-e iso-8859-8-i csiso88598e csiso88598i iso-ir-138 csisolatinhebrew",
    "ISO-8859-8": "iso-8859-8",
    "iso8859-10": "latin6 l6 iso8859-10 iso-8859-10 iso885910 iso-ir-157 csisolatin6",
    "iso8859-11": "tis-620 dos-874 windows-874 iso8859-11 iso-8859-11 iso885911",
    "iso8859-13": "iso8859-13 iso-8859-13 iso885913",
    "iso8859-14": "iso8859-14 iso-8859-14 iso885914",
    "iso8859-15": "l9 iso8859-15 iso-8859-15 iso_8859-15 iso885915 csisolatin9",
    "iso8859-16": "iso8859-16 iso-8859-16",
    "koi8-r": "koi8-r koi8_r koi8 koi cskoi8r",
    "koi8-u": "koi8-u koi8-ru",
    "mac-roman": "mac macintosh mac-roman x-mac-roman csmacintosh",
    "cp1250": "windows-1250 cp1250 x-cp1250",
    "cp1251": "windows-1251 cp1251 x-cp1251",
    "cp1252": "windows-1252 cp1252 x-cp1252 ascii us-ascii ansi_x3.4-1968 latin1 l1 iso8859-1 iso-8859-1 iso_8859-1 iso88591 iso_8859-1:1987 iso-ir-100 ibm819 cp819 csisolatin1",
    "cp1253": "windows-1253 cp1253 x-cp1253",
    "cp1254": "windows-1254 cp1254 x-cp1254 latin5 l5 iso8859-9 iso-8859-9 iso_8859-9 iso88599 iso_8859-9:1989 iso-ir-148 csisolatin5",
    "cp1255": "windows-1255 cp1255 x-cp1255",
    "cp1256": "windows-1256 cp1256 x-cp1256",
    "cp1257": "windows-1257 cp1257 x-cp1257",
    "cp1258": "windows-1258 cp1258 x-cp1258",
    "gbk": "gbk x-gbk chinese gb2312 gb_2312 gb_2312-80 csgb2312 csiso58gb231280 iso-ir-58",
    "gb18030": "gb18030",
    "big5": "big5 big5-hkscs cn-big5 csbig5 x-x-big5",
    "euc_jp": "euc-jp euc_jp x-euc-jp cseucpkdfmtjapanese",
    "iso2022_jp": "iso-2022-jp iso2022_jp csiso2022jp",
    "shift_jis": "shift-jis shift_jis sjis x-sjis ms_kanji ms932 windows-31j csshiftjis",
    "euc_kr": "euc-kr euc_kr cseuckr korean windows-949 ks_c_5601-1987 ks_c_5601-1989 ksc5601 ksc_5601 csksc56011987 iso-ir-149",
}
ENCODINGS = {label: codec for codec, labels in _LABELS.items() for label in labels.split()}

_BOMS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
_META = re.compile(rb"<meta\b[^>]*?charset\s*=\s*[\"']?\s*([\w:.+-]+)", re.I)
_COMMENT = re.compile(rb"<!--.*?(?:-->|\Z)", re.S)

# Letters by how often they come in languages that use an encoding; each candidate is scored by what it decodes to
_COMMON = {
    "cp1252": "éèêëàâäáãåæçîïíìñôöóòõøœùûüúßÿýþð" + "ÉÈÊÀÂÄÁÅÆÇÎÍÑÔÖÓØÙÛÜÚ" + "’‘“”–—…«»°§£€¡¿´·",
    "iso8859-2": "ąćęłńóśźżáčďéěíňřšťúůýžőűăâîșțţşĺľŕĄĆĘŁŃÓŚŹŻČĎŘŠŽÁÉÍÚ",
    "cp1251": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъёіїєґОЕАИНТСРВЛКМДПУЯГЗБЧХЖШЮЭФ«»—",
    "koi8-r": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъёОЕАИНТСРВЛКМДПУЯГЗБЧХЖШЮЭФ",
    "cp1253": "αβγδεζηθικλμνξοπρστυφχψωάέήίόύώςΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    "cp1255": "אבגדהוזחטיכלמנסעפצקרשתךםןףץ",
    "cp1256": "ابتثجحخدذرزسشصضطظعغفقكلمنهويءآأؤإئةىپچژگ،",
    "cp1254": "şğıİŞĞçöüÇÖÜâî",
    "iso8859-11": "".join(chr(c) for c in range(0xE01, 0xE3B)) + "เแโใไๅๆ็่้๊๋์ํ",
}
_MULTI = ("euc_jp", "shift_jis", "euc_kr", "gb18030", "big5")
_COMMON_CJK = frozenset("的一是不了在人有我他这中大来上个国到说们为子和你地出道也时年の에는を이はにがでたしるてとなもい다가고을한도리지로하기스사해大日本人年中国上生学会出行分時間你我他這個們來說國為會")


def map_encoding(label: str, fallback_utf8: bool = True) -> str | None:
    """The codec for an encoding label as browsers read it."""
    return ENCODINGS.get(label.strip().casefold(), "utf-8" if fallback_utf8 else None)


def encoding_label(label: str | Column, fallback_utf8: bool = True) -> Column:
    """``map_encoding`` natively, as a look-up in a literal map."""
    col = F.lower(F.btrim(F.col(label) if isinstance(label, str) else label, F.lit(" \t\n\x0b\f\r")))
    table = F.create_map(*[F.lit(x) for pair in ENCODINGS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, col), F.when(col.isNotNull(), F.lit("utf-8" if fallback_utf8 else None)))


def _score(data: bytes, codec: str) -> float:
    """How plausible the bytes beyond ASCII are under a single-byte codec."""
    try:
        text = data.decode(codec)
    except UnicodeDecodeError:
        return -1.0
    odd = [c for c in text if c > "\x7f"]
    if not odd or any("\x80" <= c <= "\x9f" for c in odd):
        return -1.0
    common = _COMMON[codec]
    good = sum(1.0 - 0.3 * (common.index(c) / len(common)) for c in odd if c in common)
    # a capital inside a word tells of a wrong table
    inside = sum(a.islower() and b.isupper() and b > "\x7f" for a, b in zip(text, text[1:], strict=False))
    return (good - 0.7 * inside) / len(odd)


def _multi_score(data: bytes, codec: str) -> float:
    try:
        text = data.decode(codec)
    except UnicodeDecodeError:
        return -1.0
    odd = [c for c in text if c > "\x7f"]
    if not odd:
        return -1.0
    common = sum(c in _COMMON_CJK for c in odd) / len(odd)
    proper = sum("぀" <= c <= "ヿ" or "一" <= c <= "鿿" or "가" <= c <= "힣" or "　" <= c <= "〿" or "＀" <= c <= "￯" for c in odd) / len(odd)
    half = sum("｡" <= c <= "ﾟ" for c in odd) / len(odd)
    return proper - 0.6 + common - half


_BEYOND_ASCII = re.compile(rb"[\x80-\xff]")
_GAP = re.compile(rb"[\t\n\r ]")


def _ends(data: bytes, max_len: int) -> bytes:
    """Both ends of long data, cut at white space, which is no part of another character; where they have only ASCII, what follows the first other byte."""
    half = (max_len + 1) // 2
    head, tail = data[:half], data[-half:]
    gap = _GAP.search(tail)
    head, tail = head[: max(head.rfind(x) for x in (b"\t", b"\n", b"\r", b" ")) + 1] or head, tail[gap.start() if gap else 0 :]
    if head.isascii() and tail.isascii():
        at = _BEYOND_ASCII.search(data).start()
        return data[at : at + max_len]
    return head + tail


def _is(data: bytes, codec: str, whole: bool = False) -> bool:
    """Whether the bytes are in an encoding; unless ``whole``, they may be broken off at their end."""
    try:
        codecs.getincrementaldecoder(codec)().decode(data, whole)
        return True
    except UnicodeDecodeError:
        return False


def sniff(data: bytes, max_len: int = 0) -> str:
    """The name of the encoding that the bytes are probably in; "" for no bytes.

    All bytes tell whether they are ASCII or UTF-8; of longer data than ``max_len``, only the ends are used to guess among the others.
    """
    for bom, name in _BOMS:
        if data.startswith(bom) and (name != "utf-32" or _is(data, name)):  # else UTF-16 of a text that begins with a zero
            return name
    if not data:
        return ""
    if data.isascii():
        return "iso2022_jp" if b"\x1b$B" in data or b"\x1b$@" in data else "ascii"
    # half a character, or a zero as a character, tells UTF-8 with zeros from UTF-16
    if data.count(0) > len(data) // 5 and not (_is(data, "utf-8", whole=True) and (len(data) % 2 or "\0" in data.decode("utf-16-le", "replace"))):
        even, odd = data[::2].count(0), data[1::2].count(0)
        return "utf-16-le" if odd > even else "utf-16-be"
    if _is(data, "utf-8"):
        return "utf-8"
    if max_len and len(data) > max_len:
        data = _ends(data, max_len)
        if _is(data, "utf-8"):  # damaged in between
            return "utf-8"
    best = max(_MULTI, key=lambda c: _multi_score(data, c))
    high = sum(b > 0x7F for b in data)
    if _multi_score(data, best) > 0.3 and high >= 4:
        return best
    names = list(_COMMON)
    top = max(names, key=lambda c: (_score(data, c), -names.index(c)))
    return top if _score(data, top) > 0 else "cp1252"


def _as_html5(name: str, data: bytes) -> str:
    """The encoding that HTML has for one found in the bytes: it knows no UTF-32, whose mark in little endian begins with that of UTF-16."""
    return map_encoding("utf-16-le" if name == "utf-32" and data.startswith(codecs.BOM_UTF16_LE) else name)


def detect_encoding(data: bytes, max_len: int = 131072, html5_compatible: bool = True, from_html_meta: bool = False) -> str | None:
    """The encoding of a document: its meta tag if wanted, else by its bytes (guessed by both ends of long data)."""
    if from_html_meta:
        m = _META.search(_COMMENT.sub(b"", data[:1024]))
        name = map_encoding(m[1].decode("ascii", "ignore"), fallback_utf8=False) if m else None
        if name:
            return name
    name = sniff(data, max_len)
    return _as_html5(name, data) if html5_compatible else name


class EncodingDetector:
    """Collects bytes and tells their encoding; asking starts anew."""

    def __init__(self):
        self.data = b""

    def update(self, data: bytes) -> None:
        self.data += data

    def reset(self) -> None:
        self.data = b""

    def encoding(self, html5_compatible: bool = True) -> str | None:
        name = sniff(self.data)
        found = _as_html5(name, self.data) if html5_compatible else name
        self.reset()
        return found


def _with_bom(codec: str, data: bytes) -> str:
    if codec == "utf-8":
        return "utf-8-sig" if data.startswith(codecs.BOM_UTF8) else codec
    for family in ("utf-16", "utf-32"):
        if codec.startswith(family + "-") and any(data.startswith(b) for b, n in _BOMS if n == family):
            return family
    return codec


def bytes_to_str(data: bytes, encoding: str = "utf-8", errors: str = "ignore", fallback_encodings: Sequence[str] = ("utf-8", "cp1252"), strip_bom: bool = True) -> str:
    """Text from bytes: by the encoding, then by the fallbacks, then leniently, so that the result can be encoded again."""
    first = codecs.lookup(encoding).name
    named = _with_bom if strip_bom else (lambda codec, _: codec)
    for codec in dict.fromkeys([first, *(codecs.lookup(f).name for f in fallback_encodings)]):
        try:
            return data.decode(named(codec, data))
        except UnicodeDecodeError:
            continue
    return data.decode(named(first, data), errors).encode("utf-8", errors).decode("utf-8")


_MAGIC = [(bytes.fromhex(h), kind) for kind, hexes in [
    ("text/plain", "efbbbf fffe feff 0efeff 2b2f7638 2b2f7639 2b2f762b 2b2f762f"),
    ("text/html", " ".join(f"<!{d} {h}".encode().hex() for d in ("DOCTYPE", "doctype") for h in ("html", "HTML"))),
    ("image/svg+xml", " ".join(f"<!{d} {h}".encode().hex() for d in ("DOCTYPE", "doctype") for h in ("svg", "SVG"))),
    ("application/xml", "3c3f786d6c20 003c003f0078006d006c0020"),
    ("application/rtf", "7b5c72746631"),
    ("application/msword", "d0cf11e0a1b11ae1"),
    ("image/jpeg", "ffd8ffe0 ffd8ffe1 ffd8ffe2 ffd8ffe8 ffd8ffee"),
    ("image/png", "89504e470d0a1a0a"), ("image/gif", "474946383761"), ("image/tiff", "49492a00 4d4d002a"), ("image/x-icon", "00000100"), ("image/icns", "69636e73"),
    ("image/jp2", "0000000c6a5020200d0a870a ff4fff51"), ("image/bmp", "424d"), ("image/webp", "52494646"), ("image/x-xpixmap", "2f2a2058504d202a2f"),
    ("application/pdf", "255044462d"), ("application/postscript", "25215053"), ("image/vnd.adobe.photoshop", "38425053"),
    ("application/zip", "504b0304 504b0506 504b0708"), ("application/x-tar", "7573746172003030 7573746172202000"), ("application/x-7z-compressed", "377abcaf271c"),
    ("application/gzip", "1f8b"), ("application/x-bzip2", "494e4458 425a68"), ("application/x-lz4", "04224d18"), ("application/x-xz", "fd377a585a00"), ("application/vnd.rar", "526172211a0700 526172211a070100"),
    ("font/woff", "774f4646"), ("font/woff2", "774f4632"), ("font/ttf", "0001000000"), ("application/vnd.iccprofile", "4b434d53"),
    ("application/ogg", "4f676753"), ("audio/flac", "664c6143"), ("audio/aiff", "464f524d"), ("audio/mpeg", "fffb fff2 494433"),
    ("video/mp4", "6674797069736f6d"), ("video/mpeg", "000001b3 000001ba"), ("video/x-matroska", "1a45dfa3"), ("application/x-shockwave-flash", "435753 465753"),
    ("application/x-elf", "7f454c46"), ("application/vnd.ms-cab-compressed", "4d534346"), ("application/x-iso9660-image", "4344303031"), ("application/x-mach-binary", "feedface feedfacf cefaedfe cffaedfe"),
    ("application/wasm", "0061736d"), ("application/vnd.debian.binary-package", "213c617263683e0a"), ("application/java-vm", "cafebabe"), ("application/vnd.ms-htmlhelp", "495453460300000060000000"),
] for h in hexes.split()]
_CONTROL = bytes([*range(32), *range(127, 256)])


def detect_mime(data: bytes, max_unprintable: float = 0.05) -> str:
    """The media type by the first bytes, or by the share of unprintable ones."""
    head = data[:128].lstrip()
    for magic, kind in _MAGIC:
        if data.startswith(magic) or head.startswith(magic):
            if kind in ("text/html", "application/xml"):
                if b'"-//W3C//DTD XHTML' in head:
                    return "application/xhtml+xml"
                if kind == "application/xml" and (b"<svg " in head or b'"-//W3C//DTD SVG' in head):
                    return "image/svg+xml"
            return kind
    odd = len(data) - len(data.translate(None, _CONTROL))
    return "application/octet-stream" if odd > int(len(data) * max_unprintable) else "text/plain"


def _wrap(f, kind: str, col: str | Column, **options) -> Column:
    @F.arrow_udf(kind)
    def found(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f(v, **options) for v in values.to_pylist()])

    return found((F.col(col) if isinstance(col, str) else col).cast("binary"))


def encoding_of(data: str | Column, **options) -> Column:
    return _wrap(detect_encoding, "string", data, **options)


def mime_of(data: str | Column, max_unprintable: float = 0.05) -> Column:
    return _wrap(detect_mime, "string", data, max_unprintable=max_unprintable)


def decoded(data: str | Column, encoding: str | Column = "utf-8", **options) -> Column:
    """Text from a binary column; ``encoding`` is a codec name, or a column of them."""

    @F.arrow_udf("string")
    def found(values: pa.Array, codec: pa.Array) -> pa.Array:
        return pa.array([None if v is None else bytes_to_str(v, c or "utf-8", **options) for v, c in zip(values.to_pylist(), codec.to_pylist(), strict=True)], pa.string())

    return found(F.col(data) if isinstance(data, str) else data, F.lit(encoding) if isinstance(encoding, str) else encoding)
