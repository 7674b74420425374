"""HTTP framing as Column expressions: what a transport hands over as bytes or text, and what it sends back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

END = "\r\n\r\n"
#: Each byte as the character of its number, so that string functions count bytes.
BYTES = "ISO-8859-1"
REQUESTS = "struct<rest:string,open:boolean,found:array<struct<path:string,content_length:int,close:boolean,body:string,complete:boolean>>>"


def _content_length(head: Column) -> Column:
    lower, title = r"content-length:\s*([0-9]*)", r"Content-Length:\s*([0-9]*)"
    digits = F.when(head.contains("content-length:"), F.regexp_extract(head, lower, 1)).otherwise(F.regexp_extract(head, title, 1))
    return F.coalesce(F.when(digits != "", digits.try_cast("int")), F.lit(0))


def _closes(head: Column) -> Column:
    value = F.regexp_extract(head, r"(?s)(?:Connection: )[ \t]*(.{0,5})", 1)
    small = F.regexp_extract(head, r"(?s)(?:connection: )[ \t]*(.{0,5})", 1)
    return F.lower(F.when(head.contains("Connection: "), value).otherwise(small)) == "close"


def _next(state: Column) -> Column:
    """The state with one more request cut off. The last one may be incomplete; after one that closes the connection none is read."""
    rest = state.rest
    at = F.instr(rest, END)
    head = F.when(at > 0, F.substr(rest, F.lit(1), at - 1)).otherwise(rest)
    body = F.when(at > 0, F.substr(rest, at + 4)).otherwise("")
    length = _content_length(head)
    complete = (at > 0) & (F.length(body) >= length)
    path = F.coalesce(F.get(F.split(head, " "), F.lit(1)), F.lit(""))
    one = F.struct(path.alias("path"), length.alias("content_length"), _closes(head).alias("close"), F.substr(body, F.lit(1), length).alias("body"), complete.alias("complete"))
    left = F.substr(body, length + 1)
    grown = F.struct(left.alias("rest"), (complete & ~_closes(head) & (left != "")).alias("open"), F.concat(state.found, F.array(one)).alias("found"))
    return F.when(state.open, grown.cast(REQUESTS)).otherwise(state)


def parse_raw(requests: DataFrame, raw: str = "raw") -> DataFrame:
    """A row for each request that a connection sent, one behind the other in `raw` (binary, or text as UTF-8).

    Adds place (0, 1, ...), path, content_length (bytes), close, body and complete (headers and body are all there).
    A null connection sent one incomplete request.
    """
    kind = requests.schema[raw].dataType
    data = F.coalesce(F.col(raw), F.lit("").cast(kind))
    text = F.decode(data if isinstance(kind, T.BinaryType) else F.encode(data, "UTF-8"), BYTES)
    ends = F.size(F.split(text, END, -1))
    begun = F.struct(text.alias("rest"), F.lit(True).alias("open"), F.array().cast("array<struct<path:string,content_length:int,close:boolean,body:string,complete:boolean>>").alias("found")).cast(REQUESTS)
    found = F.aggregate(F.sequence(F.lit(1), ends), begun, lambda state, _: _next(state), lambda state: state.found)
    cut = requests.select(*requests.columns, F.posexplode(found).alias("place", "_r"))
    utf8 = lambda x: F.decode(F.encode(x, BYTES), "UTF-8")
    return cut.select(*requests.columns, "place", utf8(F.col("_r.path")).alias("path"), "_r.content_length", "_r.close", utf8(F.col("_r.body")).alias("body"), "_r.complete")


def status(path: Column, ready: Column, parsed: Column) -> Column:
    """200, 400, 404 or 503 of a path; parsed: whether the body is a payload. /ready answers even before the index is there."""
    return F.when(path == "/ready", 200).when(~ready, 503).when(path == "/fraud-score", F.when(parsed, 200).otherwise(400)).otherwise(404)


def response(code: Column, path: Column, fraud_count: Column, close: Column) -> Column:
    """The response's text."""
    reason = F.when(code == 200, "OK").when(code == 400, "Bad Request").when(code == 404, "Not Found").otherwise("Service Unavailable")
    count = F.least(fraud_count, F.lit(5))
    body = F.when((code == 200) & (path == "/fraud-score"), F.concat(F.lit('{"approved":'), (count < 3).cast("string"), F.lit(',"fraud_score":'), F.format_number(count / 5.0, 1), F.lit("}"))).otherwise("")
    kind = F.when(body != "", "Content-Type: application/json\r\n").otherwise("")
    ends = F.when((code == 503) | (close & ~((code == 200) & (path == "/ready"))), "Connection: close\r\n").otherwise("")
    return F.concat(F.lit("HTTP/1.1 "), code.cast("string"), F.lit(" "), reason, F.lit("\r\n"), kind, F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n"), ends, F.lit("\r\n"), body)
