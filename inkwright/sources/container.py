"""Notebook containers: bytes to rows.

``spark.read.format("binaryFile")`` gives (path, content); one Python pass over each file emits
one row a page, with everything nested that is read there, and one row a note. What can't be
read becomes an error row; it never fails the job. Strokes and bitmaps stay bytes: metadata
queries prune them away.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwright.functions.text import LAYER, LAYER_FIELD, PAIR, page_of_key
from inkwright.operators.paragraphs import WORDS
from inkwright.session import ship

# The container's names, sizes and orientations.
SIGNATURE = re.compile(rb"(?:note|mark)SN_FILE_VER_(\d{8})")
LAYERS = ("MAINLAYER", "LAYER1", "LAYER2", "LAYER3", "BGLAYER")
HEADER_AT = 24
PORTRAIT, LARGE, LARGE_DEVICE = (1404, 1872), (1920, 2560), "N5"
CROSSWISE = {"1090", "1270"}
TITLE_STYLE = "1000254"
# What blocks say where they are silent.
HEADER_DEFAULTS = dict.fromkeys(("MODULE_LABEL", "FILE_TYPE", "APPLY_EQUIPMENT", "FINAL_OPERATION_PAGE", "FINAL_OPERATION_LAYER", "ORIGINAL_STYLE", "ORIGINAL_STYLEMD5", "DEVICE_DPI", "SOFT_DPI", "FILE_PARSE_TYPE", "APP_VERSION", "FILE_RECOGN_TYPE"), "0")
PAGE_DEFAULTS = dict.fromkeys(("PAGESTYLE", "PAGESTYLEMD5", "LAYERSWITCH", "TOTALPATH", "THUMBNAILTYPE", "RECOGNSTATUS", "RECOGNTEXT", "RECOGNFILE", "RECOGNFILESTATUS", "ORIENTATION"), "0")
LAYER_DEFAULTS = {"LAYERTYPE": "NOTE", "LAYERNAME": "MAINLAYER", "LAYERPATH": "0", "LAYERBITMAP": "0", "LAYERVECTORGRAPH": "0", "LAYERRECOGN": "0"}
LAYER_FLAGS = ("isBackgroundLayer", "isAllowAdd", "isCurrentLayer", "isVisible", "isDeleted", "isAllowUp", "isAllowDown")
PICTURE = {"keyword": "KEYWORDSITE", "title": "TITLEBITMAP", "link": "LINKBITMAP"}
ELEMENTS = f"array<struct<type:string,label:string,words:{WORDS}>>"


class Broken(ValueError):
    """A file that can't be read; the message says at which stage."""


def uint(data: bytes, at: int, size: int = 4) -> int:
    if at < 0 or at + size > len(data):
        raise Broken(f"offset {at} lies past the end")
    return int.from_bytes(data[at : at + size], "little")


def block(data: bytes, at: int) -> bytes | None:
    """The bytes at an address, after their length; cut short where the file ends."""
    return None if at == 0 else data[at + 4 : at + 4 + uint(data, at)]


def number(text: str | None) -> int:
    m = re.match(r"\s*([+-]?\d+)", text or "")
    return int(m[1]) if m else 0


def pairs(data: bytes | None) -> dict[str, list[str]]:
    """All ``<key:value>`` pairs by key, repeats in order."""
    out: dict[str, list[str]] = {}
    for key, value in re.findall(PAIR, (data or b"").decode("utf-8", "replace")):
        out.setdefault(key, []).append(value)
    return out


def single(found: dict[str, list[str]]) -> dict[str, str]:
    return {k: v[-1] for k, v in found.items()}


def layer_info(text: str) -> list[dict[str, str]]:
    return [dict(re.findall(LAYER_FIELD, body)) for body in re.findall(LAYER, text)]


def recognition(data: bytes, at: str | None) -> str | None:
    """The JSON of a page's recognized elements."""
    found = block(data, number(at))
    if not found:
        return None
    return json.dumps(json.loads(base64.b64decode(found.decode("utf-8"))).get("elements") or [])


def _page(data: bytes, no: int, at: int) -> dict:
    kv = PAGE_DEFAULTS | single(pairs(block(data, at)))
    for needed in ("LAYERINFO", "LAYERSEQ"):
        if needed not in kv:
            raise Broken(f"page {no} has no {needed}")
    layers = []
    for name in LAYERS:
        said = LAYER_DEFAULTS | single(pairs(block(data, number(kv.get(name)))))
        layers.append({"name": said["LAYERNAME"], "type": said["LAYERTYPE"], "bitmap": block(data, number(said["LAYERBITMAP"]))})
    return {
        "page_no": no,
        "page_id": kv.get("PAGEID"),
        "style": kv["PAGESTYLE"],
        "orientation": kv["ORIENTATION"],
        "layer_seq": kv["LAYERSEQ"].split(","),
        "layer_info": [list(x.items()) for x in layer_info(kv["LAYERINFO"])],
        "layers": layers,
        "elements": recognition(data, kv.get("RECOGNTEXT")),
        "total_path": block(data, number(kv.get("TOTALPATH"))),
        "extra": [(k, v) for k, v in kv.items()],
    }


def _key_order(key: str) -> tuple:
    return (0, int(key), key) if key.isdigit() else (1, 0, key)


def decode(data: bytes) -> dict:
    """A note: version, header, size, pages, titles, keywords, links, cover."""
    m = SIGNATURE.fullmatch(data[:24])
    if not m:
        raise Broken("no signature")
    footer = pairs(block(data, uint(data, len(data) - 4)))
    once = {k: v[0] for k, v in footer.items() if len(v) == 1}
    part = lambda prefix: {k[len(prefix) :].lstrip("_"): v for k, v in once.items() if k.startswith(prefix)}
    header = HEADER_DEFAULTS | single(pairs(block(data, number(once.get("FILE_FEATURE")) or HEADER_AT)))
    width, height = LARGE if header["APPLY_EQUIPMENT"] == LARGE_DEVICE else PORTRAIT
    pages = [_page(data, i + 1, number(at)) for i, (_, at) in enumerate(sorted(part("PAGE").items(), key=lambda x: _key_order(x[0])))]
    if all(p["orientation"] in CROSSWISE for p in pages):
        width, height = height, width
    marks = []
    for kind, prefix in (("keyword", "KEYWORD_"), ("title", "TITLE_"), ("link", "LINKO_")):
        for key, found in footer.items():
            for seq, at in enumerate(found if key.startswith(prefix) else ()):
                kv = single(pairs(block(data, number(at))))
                text = None
                if kind == "keyword":
                    text = (block(data, number(kv.get("KEYWORDSITE"))) or b"").decode("utf-8", "replace").replace("\0", "").strip()
                elif kind == "link" and kv.get("LINKFILE"):
                    text = re.sub(r"\.note$", "", base64.b64decode(kv["LINKFILE"]).decode("utf-8", "replace").split("/")[-1])
                if kind == "title":
                    kv = {"TITLESTYLE": TITLE_STYLE} | kv
                picture = block(data, number(kv.get(PICTURE[kind])))
                marks.append({"kind": kind, "key": key[len(prefix) :], "seq": seq, "text": text, "values": list(kv.items()), "bitmap": picture})
    covers = part("COVER")
    at = number(covers.get("0", covers.get("1")))  # a first cover without an address is no cover
    cover = block(data, at) if at > 0 else None
    return {"version": m[1].decode(), "equipment": header["APPLY_EQUIPMENT"], "page_w": width, "page_h": height, "header": list(header.items()), "pages": pages, "marks": marks, "cover": cover}


_MAP = pa.map_(pa.string(), pa.string())
_PAGE = pa.struct(
    [("page_no", pa.int32()), ("page_id", pa.string()), ("style", pa.string()), ("orientation", pa.string()), ("layer_seq", pa.list_(pa.string())), ("layer_info", pa.list_(_MAP))]
    + [("layers", pa.list_(pa.struct([("name", pa.string()), ("type", pa.string()), ("bitmap", pa.binary())]))), ("elements", pa.string()), ("total_path", pa.binary()), ("extra", _MAP)]
)
_MARK = pa.struct([("kind", pa.string()), ("key", pa.string()), ("seq", pa.int32()), ("text", pa.string()), ("values", _MAP), ("bitmap", pa.binary())])
_NOTE = pa.schema(
    [("note_id", pa.string()), ("error", pa.string()), ("version", pa.string()), ("equipment", pa.string()), ("page_w", pa.int32()), ("page_h", pa.int32())]
    + [("header", _MAP), ("pages", pa.list_(_PAGE)), ("marks", pa.list_(_MARK)), ("cover", pa.binary())]
)
NOTE = """note_id string, error string, version string, equipment string, page_w int, page_h int, header map<string,string>,
pages array<struct<page_no:int,page_id:string,style:string,orientation:string,layer_seq:array<string>,layer_info:array<map<string,string>>,layers:array<struct<name:string,type:string,bitmap:binary>>,elements:string,total_path:binary,extra:map<string,string>>>,
marks array<struct<kind:string,key:string,seq:int,text:string,values:map<string,string>,bitmap:binary>>, cover binary"""


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            try:
                row = {"note_id": path, "error": None} | decode(content.as_py() or b"")
            except (ValueError, IndexError, KeyError, AttributeError) as e:
                row = {"note_id": path, "error": f"{type(e).__name__}: {e}"}
            yield pa.RecordBatch.from_pylist([row], _NOTE)


def notes(files: DataFrame) -> DataFrame:
    """Files (path, content) as notes, one row each; ``error`` says why one couldn't be read."""
    ship(files.sparkSession)
    return files.select("path", "content").mapInArrow(_decode, NOTE)


def read(spark: SparkSession, path: str, pattern: str = "*.{note,mark}") -> DataFrame:
    return notes(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path))


def pages(found: DataFrame) -> DataFrame:
    """One row a page."""
    return found.where("error IS NULL").select("note_id", "page_w", "page_h", "equipment", F.explode("pages").alias("p")).select("note_id", "page_w", "page_h", "equipment", "p.*")


def layer_infos(page_rows: DataFrame) -> DataFrame:
    """What pages say of their layers (note_id, page_no, ordinal, layer_id, name, flags), with defaults."""
    rows = page_rows.select("note_id", "page_no", F.posexplode("layer_info").alias("ordinal", "m"))
    flags = [F.coalesce(F.col("m")[f] == "true", F.lit(False)).alias(f) for f in LAYER_FLAGS]
    number_ = F.regexp_extract(F.coalesce(F.col("m")["layerId"], F.lit("0")), r"^\s*([+-]?\d+)", 1).try_cast("int")
    return rows.select("note_id", "page_no", "ordinal", number_.alias("layer_id"), F.coalesce(F.col("m")["name"], F.lit("Main layer")).alias("name"), *flags)


def elements(page_rows: DataFrame) -> DataFrame:
    """Recognized elements (note_id, page_no, elem_idx, type, label, words)."""
    out = page_rows.select("note_id", "page_no", F.posexplode(F.from_json("elements", ELEMENTS)).alias("elem_idx", "e"))
    words = F.transform("e.words", lambda w: F.struct(w["label"].alias("label"), w["bounding-box"].alias("box")))
    return out.select("note_id", "page_no", "elem_idx", F.col("e.type").alias("type"), F.col("e.label").alias("label"), words.alias("words"))


def _marks(found: DataFrame, kind: str) -> DataFrame:
    marks = found.where("error IS NULL").select("note_id", F.posexplode(F.filter("marks", lambda m: m["kind"] == kind)).alias("ordinal", "m"))
    return marks.select("note_id", page_of_key(F.col("m.key")).alias("page_no"), "ordinal", "m.key", "m.seq", "m.text", "m.values", "m.bitmap")


def keywords(found: DataFrame) -> DataFrame:
    """Keywords with their pages and texts, in the footer's order."""
    return _marks(found, "keyword")


def titles(found: DataFrame) -> DataFrame:
    """Titles with their pages, values and bitmaps, in the footer's order."""
    return _marks(found, "title")


def links(found: DataFrame) -> DataFrame:
    """Links with their text: the file's name and, if the page they name is in this note, its first number."""
    rows = pages(found).where(F.col("page_id").isNotNull() & ~F.col("page_id").isin("0", "none")).groupBy("note_id", "page_id").agg(F.min("page_no").alias("to"))
    marks = found.select("note_id", F.explode("marks").alias("m")).where("m.kind = 'link'").select("note_id", "m.key", "m.seq", "m.text", F.col("m.values")["PAGEID"].alias("page_id"))
    return marks.join(rows, ["note_id", "page_id"], "left").withColumn("text", F.concat("text", F.coalesce(F.concat(F.lit("#Page "), F.col("to").cast("string")), F.lit(""))))
