"""Bug classes, needles and families. The tables are fixed values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: key: (primitive, OWASP category, spellings), in order. Fixed values.
CLASSES: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "command_injection": ("X", "A03", ("cmd injection", "command inject", "os.system", "subprocess", "shell=true", "exec.command", "child_process", "rce", "os command", "shell injection")),
    "sql_injection": ("R", "A03", ("sqli", "sql inject", "raw sql", "cursor.execute", "sql concat", "sql-concat")),
    "ssti": ("X", "A03", ("template injection", "render_template_string", "jinja", "sstihandler")),
    "deserialization": ("X", "A08", ("deserial", "pickle", "yaml.load", "marshal.load", "unserialize", "objectinputstream", "readobject", "xstream", "deserialization-chain")),
    "path_traversal_read": ("R", "A01", ("path travers", "directory travers", "lfi", "file read", "arbitrary file read", "send_file", "path_traversal")),
    "path_traversal_write": ("W", "A01", ("arbitrary file write", "zip slip", "path write")),
    "ssrf": ("R", "A10", ("server-side request", "urlopen", "requests.get", "metadata", "169.254")),
    "xss": ("W", "A03", ("cross-site", "innerhtml", "dangerouslyset", "html_safe", "reflected xss")),
    "authz_bypass": ("TRUST", "A01", (
        "authz", "authoriz", "auth bypass", "auth_bypass", "guard-alternate", "guard-authorization-bypass", "sibling", "skip_before", "missing security check", "idor", "broken access control",
        "auth-structural-bypass", "shouldPass", "E_TCPADMIN", "anonymous credential", "empty root", "empty password", "KILL session", "check_auth_for_kill", "no_priv_needed", "stubbed-priv-check",
        "OPTIMIZE TABLE", "skip_sys_table_check", "ANALYZE TABLE", "sql-no-priv-needed",
    )),
    "weak_secret": ("TRUST", "A02", ("weak prng", "random.randint", "math.random", "hardcoded", "secret", "api_key", "jwt", "alg:none", "weak-secret", "hardcoded credential")),
    "code_injection": ("X", "A03", (
        "code inject", "eval(", "eval", "exec(", "function(", "constantize", "dynamic-dispatch", "dynamic dispatch", "instance_eval", "class_eval", "module_eval", "dynamic code execution",
        "code execution", "dlopen", "LoadLibrary",
    )),
    "memory_corruption": ("W", "A06", (
        "buffer overflow", "heap overflow", "stack overflow", "use-after-free", "uaf", "double free", "out-of-bounds", "oob", "oob read", "oob write", "memcpy", "strcpy", "unsafe-c-api", "asan",
        "heap-buffer-overflow", "segfault",
    )),
    "integer_overflow": ("W", "A06", ("integer overflow", "int overflow", "integer-boundary", "signedness", "truncation")),
    "denial_of_service": ("DOS", "A06", (
        "dos", "denial of service", "infinite recursion", "infinite loop", "cpu hang", "resource exhaustion", "algorithmic complexity", "billion laughs", "decompression bomb",
        "stack overflow recursion", "hang", "oom", "unbounded",
    )),
    "xxe": ("R", "A05", ("xxe", "external entity", "xml entity", "!entity")),
    "api_surface": ("X", "A03", ("dangerous api", "shell.exec", "api-surface", "v1/shell", "v1/bash", "code.execute")),
    "generic": ("TRUST", "", ()),
}
#: Classes that count as one when they are compared. Fixed values.
COMPATIBLE = {"path_traversal": "path", "path_traversal_read": "path", "path_traversal_write": "path", "memory_corruption": "memory", "integer_overflow": "memory"}
#: Classes of interest and the words that show them; a text may be in several. Fixed values.
PRIORITY_NEEDLES = {
    "rce": ["command inject", "code inject", "exec", "rce", "os.system", "eval(", "deserializ", "unmarshal", "pickle", "gadget"],
    "deserialization": ["deserializ", "unmarshal", "pickle", "yaml.load", "readobject", "marshal"],
    "authz": ["authz", "authoriz", "access control", "idor", "object-level", "privilege", "rbac", "abac", "policy"],
    "authn": ["authn", "authenticat", "auth bypass", "login", "session", "jwt", "oauth", "saml", "token"],
    "ssrf": ["ssrf", "server-side request", "upstream", "proxy"],
    "path_traversal": ["path travers", "directory travers", "file read", "arbitrary file"],
    "injection_sql": ["sql inject", "sqli", "query concat"],
}
#: What the names of a function's sinks say, the first that fits. Fixed values.
SINK_FAMILIES = {
    "command_injection": ["system", "popen", "exec", "command", "spawn", "shell", "eval"],
    "sql_injection": ["query", "execute", "sql", "prepare"],
    "unsafe_deserialization": ["pickle", "yaml", "unserialize", "readobject", "unmarshal", "deserialize"],
    "memory_safety": ["strcpy", "strcat", "sprintf", "memcpy", "gets", "alloca", "malloc"],
    "path_traversal": ["open", "readfile", "writefile", "include", "require", "fs."],
    "crypto_auth": ["decrypt", "encrypt", "verify", "sign", "hmac", "jwt", "token"],
}
SHORT = 4  # spellings up to this length need other characters than letters on both sides


def spellings() -> list[tuple[str, str]]:
    """(spelling, class), the longest first and else in order."""
    named = [(s.lower(), key) for key, (_, _, own) in CLASSES.items() for s in (key.replace("_", " "), key, *own)]
    return sorted(named, key=lambda x: -len(x[0]))


def short_pattern(spelling: str) -> str:
    """A short spelling, all letters, as a word of its own; for the oracle."""
    return f"(?:^|[^a-z]){spelling}(?:[^a-z]|$)"


def bug_class(*texts: Column) -> Column:
    """The class of the longest spelling that the texts hold; generic without
    any. The table is one literal array, tried in order on a text that is put together once."""
    blob = F.lower(F.concat_ws(" ", *(F.nullif(t, F.lit("")) for t in texts)))
    words = F.concat(F.lit(" "), F.regexp_replace(blob, "[^a-z]", " "), F.lit(" "))
    table = F.array(*(F.struct(F.lit(f" {s} " if len(s) <= SHORT else s).alias("spelling"), F.lit(len(s) <= SHORT).alias("short"), F.lit(k).alias("key")) for s, k in spellings()))
    first = lambda b: F.get(F.filter(table, lambda s: F.contains(F.when(s["short"], b["words"]).otherwise(b["blob"]), s["spelling"])), F.lit(0))["key"]
    return F.get(F.transform(F.array(F.struct(blob.alias("blob"), words.alias("words"))), lambda b: F.coalesce(first(b), F.lit("generic"))), F.lit(0))


def class_group(key: Column) -> Column:
    """A name that compatible classes share."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in COMPATIBLE.items() for x in kv))[key], key)


def labels(text: Column, needles: dict[str, list[str]]) -> Column:
    """All classes of which a needle is in the text."""
    low = F.lower(text)
    has = lambda words: reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))
    return F.array_compact(F.array(*(F.when(has(words), F.lit(k)) for k, words in needles.items())))


def first_label(text: Column, needles: dict[str, list[str]], otherwise: str) -> Column:
    return F.coalesce(F.get(labels(text, needles), F.lit(0)), F.lit(otherwise))
