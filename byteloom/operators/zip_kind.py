"""What a ZIP archive is, by the names of its first members."""

from __future__ import annotations

SCAN = 4096
# Media types by how a member's name starts, or what it contains.
PREFIXES = [
    (b"xl/", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
    (b"word/", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    (b"ppt/", "application/vnd.openxmlformats-officedocument.presentationml.presentation"),
    (b"META-INF/MANIFEST.MF", "application/java-archive"),
    (b"AndroidManifest.xml", "application/vnd.android.package-archive"),
    (b"META-INF/container.xml", "application/epub+zip"),
]
CONTAINED = [(b".dist-info/", "application/x-wheel+zip")]
OPEN_DOCUMENT = {
    b"application/vnd.oasis.opendocument.text",
    b"application/vnd.oasis.opendocument.spreadsheet",
    b"application/vnd.oasis.opendocument.presentation",
    b"application/vnd.oasis.opendocument.graphics",
}


def zip_kind(data: bytes) -> str:
    data = data[:SCAN]
    field = lambda at, size: int.from_bytes(data[at : at + size], "little")
    at = 0
    while (found := data.find(b"PK\x03\x04", at)) >= 0 and len(data) >= found + 30:
        name_at = found + 30
        content_at = name_at + field(found + 26, 2)
        if content_at > len(data):
            break
        name = data[name_at:content_at]
        for prefix, mime in PREFIXES:
            if name.startswith(prefix):
                return mime
        for part, mime in CONTAINED:
            if part in name:
                return mime
        content_at += field(found + 28, 2)
        if name == b"mimetype" and field(found + 8, 2) == 0:
            content = data[content_at : content_at + field(found + 22, 4)]
            if len(content) == field(found + 22, 4) and content in OPEN_DOCUMENT:
                return content.decode()
        streamed = field(found + 6, 2) & 0x0008
        at = content_at + (0 if streamed else field(found + 18, 4))
    return "application/zip"
