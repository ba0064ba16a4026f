"""A report as a plain PDF: text lines in a built-in font on A4 pages, written without a library."""

from __future__ import annotations

LINES, SIZE, LEADING, LEFT, TOP, WIDE = 58, 9, 13, 48, 800, 92


def escaped(text: str) -> bytes:
    """A PDF string in Latin-1; other characters become question marks, bars and arrows plain signs."""
    plain = text.translate(str.maketrans({"█": "#", "→": ">", "↑": "^", "↓": "v", "…": "...", "•": "-"}))
    return plain.encode("latin-1", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")


def wrapped(line: str) -> list[str]:
    """A line in parts that fit a page's width; what goes on is set in."""
    if len(line) <= WIDE:
        return [line]
    set_in = " " * (len(line) - len(line.lstrip()) + 2)
    cut = line.rfind(" ", len(set_in), WIDE)
    cut = cut if cut > len(set_in) else WIDE
    return [line[:cut], *wrapped(set_in + line[cut:].lstrip())]


def pdf(text: str, title: str = "Repository report") -> bytes:
    lines = [part for line in text.split("\n") for part in wrapped(line)]
    pages = [lines[i : i + LINES] for i in range(0, len(lines), LINES)]
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>", b"<< /Title (" + escaped(title) + b") >>"]
    kids = []
    for page in pages:
        body = b"BT /F1 %d Tf %d TL %d %d Td\n" % (SIZE, LEADING, LEFT, TOP) + b"".join(b"(" + escaped(x) + b") Tj T*\n" for x in page) + b"ET"
        objects.append(b"<< /Length %d >>\nstream\n" % len(body) + body + b"\nendstream")
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % len(objects))
        kids.append(b"%d 0 R" % len(objects))
    objects[1] = b"<< /Type /Pages /Kids [" + b" ".join(kids) + b"] /Count %d >>" % len(kids)
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % i + body + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"trailer\n<< /Size %d /Root 1 0 R /Info 4 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start)
    return bytes(out)
