"""Registered queries: name -> (spark, folder) -> DataFrame, and the same result in plain SQL where SQL can say it."""

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} already exists")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def h(expr: str) -> str:
    """SQL text of functions.hashing.hash32."""
    return f"(('0x'||substr(md5({expr}),1,8))::BIGINT)"


def h60(expr: str) -> str:
    """SQL text of functions.hashing.draw60."""
    return f"(('0x'||substr(md5({expr}),1,15))::BIGINT)"


def chars(expr: str) -> str:
    """SQL text of the code-point tokenizer."""
    return f"list_transform(string_split({expr},''), lambda c: unicode(c)+8)"


def commas(expr: str) -> str:
    return f"md5(coalesce(array_to_string({expr},','),''))"
