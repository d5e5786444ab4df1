"""Raw mail message -> its HTML part (Arrow batches; stdlib decoders)."""

import base64
import email
import quopri

import pyarrow as pa
from pyspark.sql import functions as F

SCHEMA = "content_type string, encoding string, html string"
# messages decoded at a time; a batch may hold thousands, each several times its text
BLOCK = 64


def _decode(payload, encoding):
    if encoding == "quoted-printable":
        return quopri.decodestring(payload).decode("utf-8", errors="ignore")
    if encoding == "base64":
        return base64.b64decode(payload).decode("utf-8", errors="ignore")
    return payload


def html_part(raw):
    """(content type, transfer encoding, html) of one message."""
    if raw is None:
        return None, None, None
    try:
        message = email.message_from_string(raw)
        leaves = message.walk() if message.is_multipart() else [message]
        for leaf in leaves:
            body = leaf.get_payload()
            if leaf.get_content_type() == "text/html" and body:
                encoding = (leaf.get("Content-Transfer-Encoding") or "").lower()
                html = _decode(body, encoding)
                if message.is_multipart() or html:
                    if html:
                        return "text/html", encoding, html
                    break
        start = raw.find("<html")
        if start < 0:
            return message.get_content_type(), "", ""
        html = raw[start:]
        if "=3D" in html or "=E2=" in html:
            return "search", "quoted-printable", _decode(html, "quoted-printable")
        return "search", "", html
    except Exception:
        return "unparsed", "", raw


def decoder(keep):
    """Arrow pass: batches of the ``keep`` columns and the raw message -> decoded ones."""
    names = [*keep, "content_type", "encoding", "html"]

    def decode(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                table = [html_part(x) for x in batch.column(len(keep)).to_pylist()]
                out = [pa.array([row[i] for row in table], pa.string()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *out], names=names)

    return decode


def mime_html_part(df, raw="raw", keep=("email_id",)):
    """One output row per message: the ``keep`` columns, content_type, encoding, html.

    A narrow map over Arrow batches: no shuffle, ``BLOCK`` messages decoded at a time.
    """
    narrow = df.select(*keep, F.col(raw).alias("_raw"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(decoder(keep), f"{kept}, {SCHEMA}")
