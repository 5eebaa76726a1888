"""Small files made from rows, for queries that read them back: archives, mailboxes
and office documents in their simplest valid form."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterable
from email.message import EmailMessage
from xml.sax.saxutils import escape

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_A = "http://schemas.openxmlformats.org/drawingml/2006/main"


def zipped(members: Iterable[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def tarred(members: Iterable[tuple[str, bytes]], mode: str = "w:gz") -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def mailbox(bodies: Iterable[str]) -> bytes:
    return "".join(f"From sender\nSubject: {k}\n\n{body}\n\n" for k, body in enumerate(bodies)).encode()


def docx(paragraphs: Iterable[str]) -> bytes:
    body = "".join(f"<w:p><w:r><w:t>{escape(p)}</w:t></w:r></w:p>" for p in paragraphs)
    return zipped([("word/document.xml", f'<w:document xmlns:w="{_W}"><w:body>{body}</w:body></w:document>'.encode())])


def pptx(slides: list[str]) -> bytes:
    slide = lambda t: f'<p:sld xmlns:p="x" xmlns:a="{_A}"><a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p></p:sld>'.encode()
    return zipped((f"ppt/slides/slide{k + 1}.xml", slide(slides[k])) for k in reversed(range(len(slides))))


def xlsx(title: str, rows: list[list[str]]) -> bytes:
    cell = lambda at, v: f'<c r="{chr(65 + at)}{{}}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
    data = "".join(f"<row>{''.join(cell(k, v).format(n + 1) for k, v in enumerate(row))}</row>" for n, row in enumerate(rows))
    return zipped([
        ("xl/workbook.xml", f'<workbook xmlns="{_S}" xmlns:r="{_R}"><sheets><sheet name="{escape(title)}" r:id="r1"/></sheets></workbook>'.encode()),
        ("xl/_rels/workbook.xml.rels", b'<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>'),
        ("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_S}"><sheetData>{data}</sheetData></worksheet>'.encode()),
    ])


def odt(paragraphs: Iterable[str]) -> bytes:
    body = "".join(f"<text:p>{escape(p)}</text:p>" for p in paragraphs)
    return zipped([("content.xml", f'<o:doc xmlns:o="o" xmlns:text="t">{body}</o:doc>'.encode())])


def rtf(paragraphs: Iterable[str]) -> bytes:
    return ("{\\rtf1\\ansi{\\fonttbl f0}" + "\\par ".join(paragraphs) + "}").encode()


def eml(subject: str, body: str) -> bytes:
    m = EmailMessage()
    m["From"], m["To"], m["Subject"], m["Date"] = "Ada Brook <ada@norvale.example>", "Ben Stone <ben@tarn.example>", subject, "Sat, 03 Feb 1962 23:30:00 -0500"
    m.set_content(body)
    return m.as_bytes()
