"""A tiny corpus with every readable format; all content is invented."""

from __future__ import annotations

import io
import json
import mailbox
import os
import tarfile
import zipfile
from email.message import EmailMessage

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"

REPORT = """PRIVATE
PAGE 1
Harbour Board
FROM: Quay desk
28 JAN 62
The Harbour Board met Tarn Mills Ltd at Norvale City. All rights reserved. The licence is a license
under GPL terms, licenced by copyright."""


def zipped(members: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def docx() -> bytes:
    p = lambda t: f'<w:p><w:r><w:t>{t}</w:t></w:r></w:p>'
    body = p("First page of Norvale") + '<w:p><w:r><w:br w:type="page"/></w:r></w:p>' + p("Second page")
    return zipped({"word/document.xml": f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>'})


def xlsx() -> bytes:
    return zipped({
        "xl/workbook.xml": f'<workbook xmlns="{S}" xmlns:r="{R}"><sheets><sheet name="Boats" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{S}"><si><t>name</t></si><si><t>Gull</t></si></sst>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{S}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>tons</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>42</v></c></row></sheetData></worksheet>',
    })


def pptx() -> bytes:
    slide = lambda t: f'<p:sld xmlns:p="x" xmlns:a="{A}"><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:sld>'
    return zipped({f"ppt/slides/slide{n}.xml": slide(t) for n, t in ((10, "tenth"), (2, "second"), (1, "first"))})


def odt() -> bytes:
    return zipped({"content.xml": '<o:doc xmlns:o="o" xmlns:text="t"><text:h>Heading</text:h><text:p>Open text</text:p></o:doc>'})


def mail(sender: str, to: str, subject: str, body: str, date: str, attach: tuple[str, bytes] | None = None) -> bytes:
    m = EmailMessage()
    m["From"], m["To"], m["Subject"], m["Date"] = sender, to, subject, date
    m.set_content(body)
    if attach:
        m.add_attachment(attach[1], maintype="application", subtype="octet-stream", filename=attach[0])
    return m.as_bytes()


def write(root: str) -> None:
    def put(path: str, data: str | bytes) -> None:
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.write(data if isinstance(data, bytes) else data.encode())

    put("reports/1962-02-03 quay.txt", REPORT)
    put("reports/copy of quay.txt", REPORT)
    put("office/notes.docx", docx())
    put("office/boats.xlsx", xlsx())
    put("office/talk.pptx", pptx())
    put("office/open.odt", odt())
    put("office/table.csv", "a;b\n1;2\n;\n3;4\n")
    put("office/old.rtf", r"{\rtf1\ansi{\fonttbl f0}Rich \b text\par next}")
    put("office/renamed.doc", docx())
    put("office/broken.docx", b"not a zip")
    put("web/page.html", "<html><head><style>x{}</style><script>var a=1</script></head><body><p>Dock &amp; quay</p><p>Caf&eacute;</p></body></html>")
    put("web/latin.html", '<meta charset="iso-8859-1"><p>Café</p>'.encode("latin-1"))
    put("mail/one.eml", mail("Ada Brook <ada@norvale.example>", "Ben Stone <ben@tarn.example>", "Slip ways", "Pay DE89 3704 0044 0532 0130 00 or call +49 30 1234567.", "Sat, 03 Feb 1962 23:30:00 -0500", ("note.txt", b"attached words")))
    box = mailbox.mbox(os.path.join(root, "mail/box.mbox"))
    for k in range(2):
        box.add(mail("Ben Stone <ben@tarn.example>", "Ada Brook <ada@norvale.example>", f"Re {k}", f"answer {k}", "Sun, 04 Feb 1962 10:00:00 +0000"))
    box.close()
    put("packed.zip", zipped({"in/paper.txt": "Zipped Norvale text", "in/tool.exe": "MZ", "__MACOSX/x.txt": "no"}))
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        data = b"<p>Tarred page</p>"
        info = tarfile.TarInfo("t/page.html")
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    put("packed.tar.gz", out.getvalue())
    put("torn.zip", b"PK\x03\x04 and then nothing")
    put("other/scan.png", b"\x89PNG")
    put("other/data.bin", b"\0\1")
    put(".hidden/secret.txt", "never")


CHATS = {
    "direct.json": "\n".join(json.dumps(x) for x in ({"ts": "2020-01-01T23:30:00-05:00", "from": "ada", "to": "ben", "body": "late"}, {"ts": 1577836800, "from": "ben", "to": "ada", "body": "early"}, {"ts": "2020-01-02 08:00", "from": "ada", "to": "ben", "body": "next day"})) + "\n{broken\n",
    "group.json": json.dumps({"name": "Crew", "messages": [{"type": "message", "date": "2020-01-01T10:00:00", "from": "Ada", "text": ["hello ", {"type": "bold", "text": "all"}]}, {"type": "service", "date": "2020-01-01T10:01:00", "text": "joined"}]}),
    "harbour/2020-01-03.json": json.dumps([{"user_profile": {"real_name": "Cy Dale"}, "text": "hi", "ts": "1578009600.5"}]),
}
DUMP = r"""CREATE TABLE log (x int);
INSERT INTO `log` (ReportKey, Date, Title, Summary, Region) VALUES ('k1', '2004-01-02 10:00:00', 'It\'s "one"', 'Tom &amp;amp; Jerry', 'North'), ("k2", NULL, 'a''b', 'x,(y)', 'South');
INSERT INTO other VALUES (1);"""
