"""The text of a PDF's pages: objects found by their marks, deflated streams, page tree, text operators, glyph maps.

Objects are found by scanning, not by the file's own table, so that files with a broken table are read too. Encrypted
files and pictures of text have none.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A stream is inflated to at most so many bytes, and a file to so many in all.
MOST_STREAM, MOST_FILE = 64 << 20, 256 << 20
#: Bytes of an Arrow batch of files, and of files whose texts are held before they are passed on.
BATCH_BYTES, HELD_BYTES = 8 << 20, 1 << 20

_TOKEN = re.compile(
    rb"%[^\r\n]*|(?P<str>\()|(?P<hex><(?!<)[^>]*>)|(?P<open><<|\[)|(?P<close>>>|\])|/(?P<name>[^\x00\t\n\x0c\r ()<>\[\]{}/%]*)"
    rb"|(?P<ref>\d+[\x00\t\n\x0c\r ]+\d+[\x00\t\n\x0c\r ]+R(?![A-Za-z]))|(?P<num>[+-]?(?:\d+\.?\d*|\.\d+))|(?P<word>[A-Za-z'\"*][A-Za-z0-9'\"*]*)"
)
_ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}


class Name(str):
    """A name, such as /Page."""


class Word(str):
    """An operator."""


class Ref(int):
    """The number of an object."""


def _string(raw: bytes, at: int) -> tuple[bytes, int]:
    """The string whose bracket stands before ``at``, and where it ends."""
    out, depth = bytearray(), 1
    while at < len(raw):
        c = raw[at]
        if c == 92 and at + 1 < len(raw):
            at += 1
            c = raw[at]
            octal = re.match(rb"[0-7]{1,3}", raw[at : at + 3])
            if octal:
                out.append(int(octal[0], 8) & 255)
                at += len(octal[0]) - 1
            elif c not in (10, 13):
                out.append(_ESCAPES.get(c, c))
        elif c == 40:
            depth += 1
            out.append(c)
        elif c == 41:
            depth -= 1
            if not depth:
                return bytes(out), at + 1
            out.append(c)
        else:
            out.append(c)
        at += 1
    return bytes(out), at


def tokens(raw: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """Values and operators in order, each with where it ends; arrays are lists, dictionaries dicts."""
    stack: list[list] = []
    while match := _TOKEN.search(raw, at):
        at, kind = match.end(), match.lastgroup
        if kind is None:
            continue
        if kind == "open":
            stack.append([])
            continue
        value: object
        if kind == "close":
            if not stack:
                continue
            held = stack.pop()
            value = held if match[0] == b"]" else {held[k]: held[k + 1] for k in range(0, len(held) - 1, 2) if isinstance(held[k], Name)}
        elif kind == "str":
            value, at = _string(raw, at)
        elif kind == "hex":
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", match[0])
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif kind == "name":
            value = Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), match["name"].decode("latin-1")))
        elif kind == "ref":
            value = Ref(int(match[0].split()[0]))
        elif kind == "num":
            value = float(match[0])
        else:
            value = Word(match[0].decode("latin-1"))
        if stack:
            stack[-1].append(value)
        else:
            yield value, at


class File:
    def __init__(self, raw: bytes):
        self.objects: dict[int, tuple[object, bytes | None]] = {}
        self.read = 0
        for found in re.finditer(rb"(?<![0-9])(\d{1,10})[\x00\t\n\x0c\r ]+\d{1,5}[\x00\t\n\x0c\r ]+obj\b", raw):
            value, end = next(tokens(raw, found.end()), (None, found.end()))
            stream = None
            if isinstance(value, dict) and (mark := re.compile(rb"\s*stream\r?\n").match(raw, end)):
                size = value.get("Length")
                stop = mark.end() + int(size) if isinstance(size, float) and raw[mark.end() + int(size) :].lstrip(b"\r\n")[:9] == b"endstream" else raw.find(b"endstream", mark.end())
                stream = raw[mark.end() : stop if stop >= 0 else len(raw)]
            self.objects[int(found[1])] = (value, stream)  # the last of a number holds
        for value, stream in list(self.objects.values()):
            if isinstance(value, dict) and value.get("Type") == "ObjStm" and stream is not None:
                self._unpack(self.data(value, stream), int(value.get("First", 0)))
        trailer = [v for mark in re.finditer(rb"trailer", raw) for v, _ in [next(tokens(raw, mark.end()), (None, 0))] if isinstance(v, dict)]
        roots = [v.get("Root") for v in [*reversed(trailer), *(o for o, _ in self.objects.values() if isinstance(o, dict))] if v.get("Root") is not None]
        self.root = self.get(roots[0]) if roots else None

    def _unpack(self, raw: bytes, first: int) -> None:
        head = [int(v) for v, _ in tokens(raw[:first]) if isinstance(v, float)]
        for number, offset in zip(head[::2], head[1::2], strict=False):
            value, _ = next(tokens(raw, first + offset), (None, 0))
            self.objects.setdefault(number, (value, None))

    def get(self, value: object, depth: int = 0) -> object:
        while isinstance(value, Ref) and depth < 32:
            value, depth = self.objects.get(int(value), (None, None))[0], depth + 1
        return value

    def data(self, value: dict, stream: bytes) -> bytes:
        """A stream's bytes; none of one whose coding isn't plain or deflated."""
        kinds = self.get(value.get("Filter"))
        for kind in [self.get(k) for k in kinds] if isinstance(kinds, list) else [kinds] if kinds else []:
            if kind not in ("FlateDecode", "Fl") or self.read > MOST_FILE:
                return b""
            stream = zlib.decompressobj().decompress(stream, MOST_STREAM)
            self.read += len(stream)
        return stream

    def stream(self, value: object) -> bytes:
        """The bytes of a stream's reference, or of several, one after the other."""
        if isinstance(value, Ref) and (held := self.objects.get(int(value))) and held[1] is not None and isinstance(held[0], dict):
            return self.data(held[0], held[1])
        value = self.get(value)
        return b"\n".join(self.stream(v) for v in value) if isinstance(value, list) else b""

    def pages(self) -> list[tuple[dict, object]]:
        """The pages in order, each with its resources, which it may have from those above it."""
        out: list[tuple[dict, object]] = []
        top = self.get(self.root.get("Pages")) if isinstance(self.root, dict) else None
        waiting, seen = [(top, None)] if isinstance(top, dict) else [], set()
        while waiting:
            node, resources = waiting.pop()
            if not isinstance(node, dict) or id(node) in seen:
                continue
            seen.add(id(node))
            resources = node.get("Resources", resources)
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                waiting += [(self.get(k), resources) for k in reversed(kids)]
            else:
                out.append((node, resources))
        return out or [(v, v.get("Resources")) for _, (v, _) in sorted(self.objects.items()) if isinstance(v, dict) and v.get("Type") == "Page"]

    def fonts(self, resources: object) -> dict[str, tuple[int, dict[int, str] | None]]:
        """By name: how many bytes a code has, and the glyphs' characters, if the font maps them."""
        resources = self.get(resources)
        listed = self.get(resources.get("Font")) if isinstance(resources, dict) else None
        out = {}
        for name, ref in listed.items() if isinstance(listed, dict) else []:
            font = self.get(ref)
            if isinstance(font, dict):
                glyphs = self.stream(font["ToUnicode"]) if "ToUnicode" in font else b""
                out[str(name)] = (2 if font.get("Subtype") == "Type0" else 1, glyph_map(glyphs) if glyphs else None)
        return out


def glyph_map(raw: bytes) -> dict[int, str]:
    """Codes and their characters, from a map's single codes and ranges."""
    out: dict[int, str] = {}
    text = lambda b: b.decode("utf-16-be", "replace")
    held: list = []
    for value, _ in tokens(raw):
        if value in ("beginbfchar", "beginbfrange"):
            held = []
        elif value == "endbfchar":
            out |= {int.from_bytes(a): text(b) for a, b in zip(held[::2], held[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)}
        elif value == "endbfrange":
            for low, high, to in zip(held[::3], held[1::3], held[2::3], strict=False):
                if isinstance(low, bytes) and isinstance(high, bytes):
                    first = int.from_bytes(low)
                    for k in range(min(int.from_bytes(high) - first + 1, 1 << 16)):
                        if isinstance(to, list):
                            out[first + k] = text(to[k]) if k < len(to) and isinstance(to[k], bytes) else ""
                        elif isinstance(to, bytes) and to:
                            out[first + k] = text(to[:-2] + ((int.from_bytes(to[-2:]) + k) & 0xFFFF).to_bytes(2)) if len(to) > 1 else chr(to[0] + k)
        else:
            held.append(value)
    return out


def shown(raw: bytes, fonts: dict[str, tuple[int, dict[int, str] | None]]) -> str:
    """What a page's operators write: a new place on another line begins a line, a wide step back in an array is a blank."""
    out: list[str] = []
    width, glyphs, held, y = 1, None, [], None

    def write(value: bytes) -> None:
        if glyphs is None:
            out.append(value.decode("utf-16-be" if width == 2 else "cp1252", "replace"))
        else:
            out.append("".join(glyphs.get(int.from_bytes(value[k : k + width]), "") for k in range(0, len(value), width)))

    def line() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    for value, _ in tokens(raw):
        if not isinstance(value, Word):
            held.append(value)
            continue
        if value == "Tf" and len(held) > 1:
            width, glyphs = fonts.get(str(held[-2]), (1, None))
        elif value in ("Td", "TD") and len(held) > 1 and held[-1] != 0 or value == "T*":
            line()
        elif value == "Tm" and len(held) > 5:
            if y is not None and held[-1] != y:
                line()
            y = held[-1]
        elif value in ("Tj", "'", '"') and held and isinstance(held[-1], bytes):
            if value != "Tj":
                line()
            write(held[-1])
        elif value == "TJ" and held and isinstance(held[-1], list):
            for part in held[-1]:
                if isinstance(part, bytes):
                    write(part)
                elif isinstance(part, float) and part < -200:
                    out.append(" ")
        held = []
    return "".join(out).strip("\n")


def texts(raw: bytes | None, most: int | None = None) -> list[str]:
    """The texts of the first pages; none of a file that can't be read."""
    try:
        file = File(raw or b"")
        return [shown(file.stream(page.get("Contents")), file.fonts(resources)) for page, resources in file.pages()[:most]]
    except Exception:  # whatever a broken file does, it has no text
        return []


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that many files don't make one batch outgrow a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def parts(batch: pa.RecordBatch, column: str, most: int = HELD_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` bytes of a column, a row at least."""
    at, held = 0, 0
    for k, size in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if held and held + (size or 0) > most:
            yield batch.slice(at, k - at)
            at, held = k, 0
        held += size or 0
    if at < batch.num_rows:
        yield batch.slice(at)


def page_texts(found: DataFrame, content: str = "content", most: int | None = None) -> DataFrame:
    """The rows with ``pages``, the texts of their first pages, instead of their content. A worker holds a batch of at most
    ``BATCH_BYTES``, or of one file, whatever the number of rows (set for the session), and the texts of part of it."""
    small_batches(found.sparkSession)
    schema = found.withColumn("pages", F.array().cast("array<string>")).drop(content).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, content):
                read = pa.array([texts(x.as_py(), most) for x in batch.column(content)], pa.list_(pa.string()))
                kept = [n for n in batch.schema.names if n != content]
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], read], [*kept, "pages"])

    return found.mapInArrow(run, schema)
