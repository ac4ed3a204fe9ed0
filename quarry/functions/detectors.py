"""Pattern tables of the line detectors: (pattern, title, score). Fixed values."""

from __future__ import annotations

#: Secrets, any case.
SECRETS = [
    (r"AKIA[0-9A-Z]{16}", "AWS access key", 7.5),
    (r"ghp_[A-Za-z0-9_]{36}", "GitHub personal access token", 8.5),
    (r"glpat-[A-Za-z0-9_\-]{20,}", "GitLab personal access token", 8.5),
    (r"xox[baprs]-[0-9]{10,13}-[0-9]{10,13}[a-zA-Z0-9-]*", "Slack token", 7.5),
    (r"sk-[A-Za-z0-9]{32,}", "OpenAI / Stripe secret key", 8.5),
    (r"-----BEGIN (RSA |DSA |EC |OPENSSH )?PRIVATE KEY-----", "Private key material", 8.5),
    (r"api[_-]?key\s*[:=]\s*['\"][A-Za-z0-9_\-]{16,}['\"]", "Hardcoded API key", 7.0),
    (r"password\s*[:=]\s*['\"][^'\"]{6,}['\"]", "Hardcoded password", 7.0),
]
#: Comparisons and random numbers in cryptography, by language, any case.
CRYPTO = {
    "python": [
        (r"==\s*(?:token|secret|password|api_key|hmac|hash|mac|signature|digest)", "Non-constant-time comparison on secret value", 7.0),
        (r"random\.(random|randint|choice|randrange)\s*\(", "Weak PRNG for security use", 6.5),
        (r"hashlib\.(md5|sha1)\s*\(", "Weak hash algorithm for security decision", 5.5),
        (r"AES\.new\([^)]*AES\.MODE_ECB", "AES ECB mode - deterministic encryption", 7.0),
    ],
    "node": [
        (r"===?\s*(?:token|secret|password|apiKey|hmac|hash|mac|signature)", "Non-constant-time comparison on secret", 7.0),
        (r"Math\.random\s*\(\)", "Math.random() for security use", 7.5),
        (r"createHash\s*\(\s*['\"](?:md5|sha1)['\"]", "Weak hash algorithm", 5.5),
    ],
    "java": [
        (r"\.equals\s*\(\s*(?:token|secret|password|apiKey|hmac|hash|mac|signature)", "Non-constant-time comparison via String.equals()", 7.0),
        (r"new\s+Random\s*\(\)", "java.util.Random for security use", 6.5),
        (r"getInstance\s*\(\s*['\"](?:MD5|SHA-1)['\"]", "Weak hash algorithm", 5.5),
    ],
    "go": [
        (r"==\s*(?:token|secret|password|apiKey|hmac|hash|mac|signature)", "Non-constant-time comparison on secret", 7.0),
        (r"math/rand", "math/rand for security use", 6.5),
    ],
    "c/cpp": [
        (r"strcmp\s*\(\s*\w*(token|secret|password|key|hash|mac|hmac|nonce)", "strcmp on secret value - timing side-channel", 7.5),
        (r"memcmp\s*\(\s*\w*(token|secret|password|key|hash|mac|hmac)", "memcmp on secret - timing side-channel", 7.0),
        (r"\brand\s*\(\s*\)", "rand() for security use", 7.0),
        (r"srand\s*\(\s*time\s*\(", "srand(time()) - predictable seed", 7.5),
    ],
    "php": [
        (r"===?\s*\$(?:token|secret|password|api_key|hmac|hash|mac|signature)", "Non-constant-time comparison on secret", 7.0),
        (r"\brand\s*\(\s*\)|mt_rand\s*\(\s*\)", "Weak PRNG for security use", 6.5),
    ],
}
#: Integer boundaries, by language.
INTEGERS = {
    "c/cpp": [
        (r"\batoi\s*\(", "Unchecked atoi() - no range validation on converted integer", 7.0),
        (r"\bstrtol\s*\([^)]+\)\s*;", "strtol() without errno/range check", 6.5),
        (r"\(\s*(int|short|char)\s*\)\s*\w+", "Narrowing integer cast - potential truncation", 6.0),
        (r"\(\s*size_t\s*\)\s*\w+", "Cast to size_t - negative value becomes huge unsigned", 7.5),
        (r"\bmalloc\s*\([^)]*\*[^)]*\)", "malloc with multiplication - potential integer overflow in size", 8.0),
        (r"\brealloc\s*\([^)]+\)\s*;", "realloc() return value unchecked - may return NULL on failure", 7.0),
        (r"\blen\s*[-+]\s*\d+", "Arithmetic on length variable - potential off-by-one or underflow", 6.5),
        (r"if\s*\([^)]*<\s*0[^)]*\)", "Signed comparison on potentially unsigned value", 5.5),
    ],
    "python": [
        (r"\bint\s*\(\s*(request|params|args|input|sys\.argv)", "Unchecked int() from untrusted input", 6.0),
        (r"\brange\s*\(\s*int\s*\(", "range() with user-controlled size - potential DoS", 5.5),
    ],
    "go": [
        (r"\bstrconv\.Atoi\s*\(", "Atoi without bounds check on result", 6.0),
        (r"\bint\(\w+\)", "Type cast to int - potential truncation on 32-bit", 5.5),
        (r"\bmake\s*\([^,]+,\s*\w+\)", "make() with user-controlled size - potential DoS or overflow", 6.5),
    ],
    "java": [
        (r"Integer\.parseInt\s*\(", "parseInt without try-catch or range validation", 5.5),
        (r"\(int\)\s*\w+", "Narrowing cast to int - potential truncation from long", 6.0),
        (r"\bnew\s+byte\s*\[\s*\w+", "Array allocation with variable size - unchecked bounds", 6.5),
    ],
    "php": [
        (r"\bintval\s*\(\s*\$", "intval on user input without validation", 5.5),
        (r"\(int\)\s*\$", "Cast to int from user data", 5.5),
    ],
}
#: Containers, any case.
CONTAINERS = [
    (r"--privileged", "Privileged container flag", 8.5),
    (r"/proc\b|/sys\b|/dev\b", "Host filesystem mount", 7.0),
    (r"USER\s+root|user:\s*root", "Container runs as root", 6.0),
    (r"EXPOSE\s+(22|3306|5432|27017|6379|11211)\b", "Sensitive port exposed", 5.5),
    (r"LD_PRELOAD|GCONV_PATH|LD_LIBRARY_PATH", "Dangerous environment variable", 7.5),
    (r"(?:curl|wget)\s+[^\n]*\|\s*(?:bash|sh)", "Pipe-to-shell install pattern", 6.5),
    (r"--cap-add\s+(?:SYS_ADMIN|SYS_PTRACE|NET_ADMIN|ALL)", "Dangerous capability added", 7.5),
    (r"network_mode:\s*host", "Host network mode", 6.5),
]
#: What prose holds: addresses, links, numbers, license lines. Ours.
PROSE = [
    (r"[a-z0-9._-]+@[a-z0-9-]+\.[a-z]{2,}", "Mail address", 3.0),
    (r"https?://[^\s]+", "Link", 1.0),
    (r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "Network address", 2.0),
    (r"licen[sc]e|copyright", "License line", 1.0),
    (r"[0-9a-f]{24,}", "Long hexadecimal number", 5.0),
]
