"""Station-snapshot workbooks.

Workbooks are read on the executors: ``binaryFile`` yields one row per
workbook file and ``mapInPandas`` unpacks it (an .xlsx file is a zip of
XML parts, read with the standard library) into one row per sheet row:
``(path, sheet_names, used_sheet, row_idx, cells, dates)``.  Header detection,
row filters and the positional column mapping are then DataFrame
operations.  A workbook is one file, so it is the unit of work; it is read
event by event, so a task holds its compressed bytes, its strings and one
batch of rows.  Numbers shown as dates become date texts.
"""

from __future__ import annotations

import datetime
import io
import itertools
import re
import zipfile
from array import array
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pedalytics import schemas as K

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
R_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
REL_NS = "{http://schemas.openxmlformats.org/package/2006/relationships}"

SHEET_ROWS = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("sheet_names", T.StringType()),
    T.StructField("used_sheet", T.StringType()),
    T.StructField("row_idx", T.IntegerType()),
    T.StructField("cells", T.ArrayType(T.StringType())),
    T.StructField("dates", T.ArrayType(T.IntegerType())),  # places of the cells that are dates
    T.StructField("error", T.StringType()),
])
BATCH_ROWS = 5_000      # sheet rows handed on at a time


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _text(node) -> str:
    """Text of a string item: its own <t> plus rich-text runs; phonetic guides (<rPh>) ignored."""
    parts = [t.text or "" for t in node.findall("m:t", NS)]
    for run in node.findall("m:r", NS):
        parts += [t.text or "" for t in run.findall("m:t", NS)]
    return "".join(parts)


def _elements(stream, tag: str):
    """Complete elements named ``tag`` one by one; what has been handed out is forgotten."""
    name, open_ = f"{{{NS['m']}}}{tag}", []
    for event, node in ET.iterparse(stream, events=("start", "end")):
        if event == "start":
            open_.append(node)
            continue
        open_.pop()
        if node.tag == name:
            yield node
            if open_:
                open_[-1].clear()


class SharedStrings:
    """A workbook's strings as one run of bytes with offsets, an eighth of what as many Python strings take."""

    def __init__(self, items=()):
        self.data, self.ends = bytearray(), array("Q", [0])
        for text in items:
            self.data += text.encode("utf-8", "surrogatepass")
            self.ends.append(len(self.data))

    def __getitem__(self, i: int) -> str:
        return self.data[self.ends[i]:self.ends[i + 1]].decode("utf-8", "surrogatepass")


# fixed values: the format's built-in number formats for dates and times
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
# parts of a number format that are literal: quoted text, escaped, padded or repeated characters, colours and conditions
_LITERAL = re.compile(r'"[^"]*"|\\.|_.|\*.|\[(?!(?:h+|m+|s+)\])[^\]]*\]', re.IGNORECASE)


def shows_dates(code: str) -> bool:
    """True for a number format that shows a date or a time."""
    return "general" not in code.lower() and bool(re.search("[dmyhs]", _LITERAL.sub("", code), re.IGNORECASE))


def date_styles(styles: bytes) -> list[bool]:
    """Per cell style of the workbook whether its numbers are dates."""
    root = ET.fromstring(styles)
    own = {int(f.get("numFmtId")): shows_dates(f.get("formatCode") or "") for f in root.iterfind("m:numFmts/m:numFmt", NS)}
    ids = [int(x.get("numFmtId") or 0) for x in root.iterfind("m:cellXfs/m:xf", NS)]
    return [own.get(i, i in DATE_FORMATS) for i in ids]


def date_text(serial: float, from_1904: bool = False) -> str:
    """Date and time of a serial number as text; below one day only the time of day.

    The 1900 system counts a 29 February 1900 that never was, so its day 60
    and all before it are a day off.
    """
    moment = datetime.timedelta(milliseconds=round(serial * 86_400_000))
    if 0 <= serial < 1:
        return str((datetime.datetime.min + moment).time())
    start = datetime.datetime(1904, 1, 1) if from_1904 else datetime.datetime(1899, 12, 31 if serial < 60 else 30)
    return str(start + moment)


def _cell(c, shared: SharedStrings, dates: list[bool], from_1904: bool) -> tuple[str | None, bool]:
    """A cell's text, and whether it is a date."""
    kind, v = c.get("t"), c.find("m:v", NS)
    if kind == "inlineStr":
        return (_text(c.find("m:is", NS)) if c.find("m:is", NS) is not None else None), False
    if v is None or not v.text or kind == "e":  # an error value counts as missing
        return None, False
    if kind == "s":
        return shared[int(v.text)], False
    if kind == "b":
        return ("True" if v.text == "1" else "False"), False
    if kind == "d":
        return str(datetime.datetime.fromisoformat(v.text)), True
    if kind in (None, "n") and dates and int(c.get("s") or 0) < len(dates) and dates[int(c.get("s") or 0)]:
        return date_text(float(v.text), from_1904), True
    return v.text, False


def open_sheet(data: bytes, preferred: str = K.SNAPSHOT_SHEET):
    """(sheet names, used sheet, rows) of a workbook's preferred (else first) sheet.

    Rows come one by one as (row index, cells, places of date cells): neither
    the sheet nor its strings are ever held as a tree.
    """
    z = zipfile.ZipFile(io.BytesIO(data))
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    sheets = [(s.get("name"), s.get(R_ID)) for s in wb.find("m:sheets", NS)]
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    targets = {r.get("Id"): r.get("Target") for r in rels.iter(f"{REL_NS}Relationship")}
    names = [n for n, _ in sheets]
    used = preferred if preferred in names else names[0]
    target = targets[dict(sheets)[used]].lstrip("/")
    target = target if target.startswith("xl/") else "xl/" + target
    setting = wb.find("m:workbookPr", NS)
    from_1904 = setting is not None and setting.get("date1904") in ("1", "true")

    def rows():
        shared, dates = SharedStrings(), []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as part:
                shared = SharedStrings(_text(si) for si in _elements(part, "si"))
        if "xl/styles.xml" in z.namelist():
            dates = date_styles(z.read("xl/styles.xml"))
        last_row = -1
        with z.open(target) as part:
            for row in _elements(part, "row"):
                # row and cell references are optional: fall back to counting positions
                last_row = int(row.get("r")) - 1 if row.get("r") else last_row + 1
                cells: dict[int, str] = {}
                dated = []
                last_col = -1
                for c in row.findall("m:c", NS):
                    last_col = _col_index(c.get("r")) if c.get("r") else last_col + 1
                    val, is_date = _cell(c, shared, dates, from_1904)
                    if val is not None and val != "":
                        cells[last_col] = val
                        if is_date:
                            dated.append(last_col)
                width = max(cells) + 1 if cells else 0
                yield last_row, [cells.get(i) for i in range(width)], dated

    return names, used, rows()


def read_sheet(data: bytes, preferred: str = K.SNAPSHOT_SHEET):
    """(sheet_names, used_sheet, [(row_idx, cells)]) of a workbook's preferred (else first) sheet."""
    names, used, rows = open_sheet(data, preferred)
    return names, used, [(i, cells) for i, cells, _ in rows]


def sheet_frames(path: str, data: bytes, most: int = BATCH_ROWS):
    """A workbook's rows as frames of at most ``most`` rows; what breaks it becomes a last row that loads stop on."""
    columns = SHEET_ROWS.fieldNames()
    try:
        names, used, rows = open_sheet(data)
        while out := [(path, ", ".join(names), used, i, cells, dated, None) for i, cells, dated in itertools.islice(rows, most)]:
            yield pd.DataFrame(out, columns=columns)
    except Exception as e:  # noqa: BLE001
        yield pd.DataFrame([(path, None, None, None, None, None, f"{type(e).__name__}: {e}")], columns=columns)


def _sheet_batches(it):
    for pdf in it:
        for path, content in zip(pdf["path"], pdf["content"]):
            yield from sheet_frames(path, bytes(content))


def sheet_rows(workbooks: DataFrame) -> DataFrame:
    """One row per sheet row of each workbook in a ``binaryFile`` frame (path, content)."""
    return workbooks.select("path", "content").mapInPandas(_sheet_batches, SHEET_ROWS)


# ---------------------------------------------------------------------------
# Writing (used to turn snapshot tables into workbooks for ingest tests)
# ---------------------------------------------------------------------------
_NUMBER = re.compile(r"^-?[0-9]+(\.[0-9]+)?$")
_MOMENT = re.compile(r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$")

# sheet layout of the public snapshot workbooks: title, header, sub-header, then data
TITLE_ROWS = (("공공자전거 대여소 정보",), ())
HEADER_ROW = ("대여소\n번호", "보관소(대여소)명", "자치구", "상세주소", "위도", "경도", "설치\n시기",
              "설치형태", None, "운영\n방식")
SUB_HEADER_ROW = (None, None, None, None, None, None, None, "LCD", "QR", None)


def _ref(col: int, row: int) -> str:
    s, n = "", col + 1
    while n:
        n, r = divmod(n - 1, 26)
        s = chr(65 + r) + s
    return f"{s}{row + 1}"


def write_workbook(rows: list[tuple], sheet: str = K.SNAPSHOT_SHEET) -> bytes:
    """A minimal .xlsx with the snapshot layout; missing ('nan'/None) values are empty cells, moments date cells."""
    grid = [list(TITLE_ROWS[0]), list(TITLE_ROWS[1]), list(HEADER_ROW), list(SUB_HEADER_ROW), []]
    grid += [list(r) for r in rows]
    strings: dict[str, int] = {}
    xml_rows = []
    for ri, r in enumerate(grid):
        cells = []
        for ci, v in enumerate(r):
            if v is None or v == "nan" or v == "":
                continue
            v = str(v)
            if _MOMENT.match(v):
                days = (datetime.datetime.fromisoformat(v) - datetime.datetime(1899, 12, 30)) / datetime.timedelta(days=1)
                cells.append(f'<c r="{_ref(ci, ri)}" s="1"><v>{days!r}</v></c>')
            elif _NUMBER.match(v):
                cells.append(f'<c r="{_ref(ci, ri)}"><v>{v}</v></c>')
            else:
                k = strings.setdefault(v, len(strings))
                cells.append(f'<c r="{_ref(ci, ri)}" t="s"><v>{k}</v></c>')
        xml_rows.append(f'<row r="{ri + 1}">{"".join(cells)}</row>')
    m = NS["m"]
    sheet_xml = f'<worksheet xmlns="{m}"><sheetData>{"".join(xml_rows)}</sheetData></worksheet>'
    sst = "".join(f"<si><t xml:space=\"preserve\">{escape(s)}</t></si>" for s in strings)
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pkg = "http://schemas.openxmlformats.org/package/2006/relationships"
    ct = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml":
            '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
            '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            '<Default Extension="xml" ContentType="application/xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="{ct}.sheet.main+xml"/>'
            f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{ct}.worksheet+xml"/>'
            f'<Override PartName="/xl/styles.xml" ContentType="{ct}.styles+xml"/>'
            f'<Override PartName="/xl/sharedStrings.xml" ContentType="{ct}.sharedStrings+xml"/>'
            '</Types>',
        "_rels/.rels":
            f'<Relationships xmlns="{pkg}"><Relationship Id="rId1" Type="{rel}/officeDocument" '
            'Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml":
            f'<workbook xmlns="{m}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" sheetId="1" '
            'r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels":
            f'<Relationships xmlns="{pkg}"><Relationship Id="rId1" Type="{rel}/worksheet" '
            'Target="worksheets/sheet1.xml"/><Relationship Id="rId2" '
            f'Type="{rel}/sharedStrings" Target="sharedStrings.xml"/><Relationship Id="rId3" '
            f'Type="{rel}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml":
            f'<styleSheet xmlns="{m}"><numFmts count="1"><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd"/></numFmts>'
            '<fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders>'
            '<cellStyleXfs count="1"><xf/></cellStyleXfs>'
            '<cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="170" applyNumberFormat="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": sheet_xml,
        "xl/sharedStrings.xml": f'<sst xmlns="{m}">{sst}</sst>',
    }
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + body)
    return buf.getvalue()
