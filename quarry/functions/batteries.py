"""Pattern batteries of the source detectors.

A rule is (pattern, title, score) or (pattern, title, score, unless): a match
doesn't count if what follows it begins with ``unless``, which stands for a
negative lookahead. Patterns, titles and scores are fixed values.
"""

from __future__ import annotations

_ARGUMENTS = r"(?:[^()]|\([^()]*\))*"


def unbounded(pattern: str) -> str:
    """The pattern as Spark runs it. Java's matcher calls itself once a character
    of a repeated choice, which a long call doesn't survive; a possessive one
    doesn't, and takes the same texts, as the choices begin differently."""
    return pattern.replace(_ARGUMENTS, r"(?:[^()]++|\([^()]*+\))*+")


#: The suffixes of each language's files. Fixed values.
SUFFIXES = {
    "python": [".py"], "node": [".js", ".ts"], "ruby/rails": [".rb"], "go": [".go"], "java": [".java"], "php": [".php"], "c/cpp": [".c", ".cpp", ".h"],
}
#: Unsafe calls of C and of PHP extensions. Fixed values.
UNSAFE_C = [
    (r"\bmalloc\s*\((?:[^()]|\([^()]*\))*\)\s*;", "malloc() without NULL check", 8.0, r"\s*if"),
    (r"\bcalloc\s*\((?:[^()]|\([^()]*\))*\)\s*;", "calloc() without NULL check", 7.5, r"\s*if"),
    (r"\brealloc\s*\((?:[^()]|\([^()]*\))*\)\s*;", "realloc() without return check", 7.5),
    (r"\bsprintf\s*\(", "sprintf() - use snprintf() instead", 7.5),
    (r"\bstrcat\s*\(", "strcat() - use strncat() instead", 7.0),
    (r"\bstrcpy\s*\(", "strcpy() - use strncpy() or strlcpy()", 7.5),
    (r"\bgets\s*\(", "gets() - REMOVED in C11, use fgets()", 9.0),
    (r"\bfree\s*\((?:[^()]|\([^()]*\))*\)\s*;", "free() without setting pointer to NULL", 6.0, r"\s*\w+\s*=\s*NULL"),
    (r"\bZVAL_STRING\s*\(", "ZVAL_STRING - check for type confusion", 5.5),
    (r"\bconvert_to_string\s*\(", "convert_to_string - implicit type coercion", 5.5),
    (r"\bemalloc\s*\((?:[^()]|\([^()]*\))*\)\s*;", "emalloc() without NULL check", 7.5, r"\s*if"),
    (r"\bZ_STR(VAL|LEN)\s*\(", "Z_STRVAL/Z_STRLEN without ZVAL_DEREF", 6.0),
    (r"\bZ_TYPE_P?\s*\([^)]+\)\s*!=\s*IS_", "zval type check pattern", 5.0),
    (r"\bsizeof\s*\([^)]*\)\s*[-+]\s*\d+", "sizeof arithmetic - potential miscalculation", 6.5),
]
#: Boundaries of parsers, any language. Fixed values.
PARSERS = [
    (r"(malloc|calloc|emalloc|new\s+\w+\[)\s*\([^)]*(?:len|size|count|num|length)\b", "Allocation from parsed size field", 8.0),
    (r"while\s*\([^)]*(!|!=)\s*(EOF|NULL|0|nil|None|\"\")", "Loop until sentinel without length bound", 6.0),
    (r"yaml_parser_parse|yaml_event_t|yaml_document_t", "libyaml parser usage", 5.5),
    (r"yaml_emitter_emit|yaml_scalar_event_initialize", "libyaml emitter usage", 5.0),
]
#: Where a parse function begins, by language. Fixed values.
PARSE_FUNCTION = {
    "python": r"def\s+\w*parse\w*\s*\(", "ruby/rails": r"def\s+\w*parse\w*", "node": r"function\s+\w*parse\w*\s*\(", "c/cpp": r"\w+\s+\w*parse\w*\s*\(", "go": r"func\s+\w*[Pp]arse\w*\s*\(",
    "php": r"function\s+\w*parse\w*\s*\(",
}
#: Queries put together from strings, by language. Fixed values.
SQL_CONCAT = {
    "java": [
        (r"(?:execute|executeQuery|executeUpdate|prepareStatement|createQuery|createSQLQuery|createNativeQuery)\s*\([^)]*\+", "SQL query with string concatenation", 8.0),
        (r"(?:String\s+(?:sql|query|hql|jpql)\s*=\s*\"[^\"]*\"\s*\+)", "SQL string variable built with concatenation", 7.5),
        (r"statement\.execute\s*\([^)]*\+", "JDBC statement.execute with concatenation", 8.0),
    ],
    "python": [
        (r"(?:execute|executemany)\s*\(\s*(?:f\"|f'|\"[^\"]*\"\s*%|'[^']*'\s*%|\"[^\"]*\"\s*\.format)", "SQL with f-string/format/percent", 8.0),
        (r"cursor\.execute\s*\([^)]*\+", "SQL with string concatenation", 7.5),
    ],
    "ruby/rails": [(r"(?:where|find_by_sql|execute|select_all)\s*\([^)]*#\{", "SQL with Ruby string interpolation", 7.5)],
    "node": [(r"(?:query|execute|raw)\s*\(\s*(?:`[^`]*\$\{|\"[^\"]*\"\s*\+|'[^']*'\s*\+)", "SQL with template literal/concatenation", 7.5)],
    "php": [(r"(?:mysql_query|mysqli_query|pg_query|->query)\s*\([^)]*\$", "SQL with PHP variable interpolation", 7.5)],
}
#: Dispatch whose target comes from input, by language. Fixed values.
DISPATCH = {
    "ruby/rails": [
        (r"(?:send|public_send)\s*\(\s*(?:params|request|args|input|data)", "Dynamic dispatch via send with user input", 8.5),
        (r"constantize|const_get\s*\(", "Dynamic class instantiation via constantize", 8.0),
        (r"Kernel\.open\s*\(|URI\.open\s*\(", "Kernel#open / URI.open (pipe command injection)", 9.0),
    ],
    "python": [
        (r"importlib\.import_module\s*\([^)]*(?:request|args|input|params|user|data|sys\.argv)", "Dynamic module import with user input", 8.0),
        (r"getattr\s*\([^,]+,\s*(?:request|args|input|params|data)", "getattr with user-controlled attribute", 7.5),
        (r"__import__\s*\(", "Dynamic import via __import__", 7.5),
    ],
    "java": [
        (r"Class\.forName\s*\([^)]*(?:request|param|input|arg|header|user)", "Reflection with user-controlled class name", 8.5),
        (r"SpelExpressionParser\s*\(\s*\).*parseExpression\s*\([^)]*(?:request|param|input|arg)", "SpEL injection via user input", 9.0),
        (r"ScriptEngine.*eval\s*\([^)]*(?:request|param|input|arg|user)", "Script engine evaluation with user input", 9.0),
    ],
    "node": [
        (r"require\s*\(\s*(?:req\.|params\.|input|user|data|args)", "Dynamic require with user input", 8.5),
        (r"\[\s*(?:req\.|params\.|input|user)\s*[^\]]*\]\s*\(", "Bracket notation method dispatch", 7.5),
    ],
    "php": [
        (r"call_user_func\s*\(\s*\$(?:_GET|_POST|_REQUEST|_COOKIE|input|user|data)", "call_user_func with user-controlled callback", 9.0),
        (r"\$\$\w+|\$\{?\$", "Variable variables ($$var)", 7.0),
    ],
}
#: Removal in a single pass, which nesting survives, by language. Fixed values.
SINGLE_PASS = {
    "python": [
        (r"\.replace\s*\(\s*['\"]\.\.\/['\"]", "Single-pass ../ removal - ....// reconstitutes to ../", 7.0),
        (r"re\.sub\s*\(\s*['\"]<script", "Single-pass script tag removal - nesting bypasses", 6.5),
        (r"\.replace\s*\(\s*['\"]javascript:", "Single-pass javascript: removal - nesting bypasses", 6.5),
    ],
    "php": [
        (r"str_replace\s*\(\s*['\"]\.\.\/['\"]", "PHP single-pass str_replace ../ - ....// reconstitutes", 7.5),
        (r"str_replace\s*\(\s*['\"]<script", "PHP single-pass script removal - nesting bypasses", 6.5),
    ],
    "node": [
        (r"\.replace\s*\(\s*['\"]\.\.\/['\"]", "JS single-pass ../ removal - ....// reconstitutes", 7.0),
        (r"\.replaceAll\s*\(\s*['\"]javascript:", "JS single-pass javascript: removal", 6.5),
    ],
    "ruby/rails": [
        (r"\.gsub\s*\(\s*['\"]\.\.\/['\"]", "Ruby gsub ../ removal - single pass", 7.0),
        (r"\.sub\s*\(\s*['\"]\.\.\/['\"]", "Ruby sub ../ removal - replaces only first occurrence", 7.5),
    ],
    "go": [
        (r"strings\.ReplaceAll\s*\(\s*\w+\s*,\s*\"\.\.\/\"", "Go ReplaceAll ../ - single pass, reconstitutable", 7.0),
        (r"strings\.NewReplacer\s*\(\s*\"\.\.\/\"", "Go Replacer ../ - single pass", 7.0),
    ],
    "java": [(r"\.replace\s*\(\s*\"\.\.\/\"", "Java replace ../ - non-recursive single pass", 7.0)],
    "c/cpp": [(r"str_replace|strstr.*memmove|while.*strstr.*\.\./", "C custom path sanitizer - verify loop-until-clean", 6.0)],
}
#: Errors that are swallowed, by language. Fixed values.
ERROR_PATHS = {
    "python": [
        (r"except\s*:\s*\n\s*(pass|\.\.\.)", "Bare except with pass/... - swallows all errors including auth failures", 7.0),
        (r"except\s+Exception\s*:\s*\n\s*(pass|continue|\.\.\.)", "Broad except swallowing errors - may hide security failures", 6.0),
        (r"except\s*:\s*\n\s*return\s+(True|None)", "Except returning truthy/None - fail-open pattern", 7.5),
    ],
    "node": [
        (r"catch\s*\(\s*\w*\s*\)\s*\{\s*\}", "Empty catch block - swallows errors silently", 6.5),
        (r"catch\s*\(\s*\w*\s*\)\s*\{\s*(//|/\*)", "Catch with only comment - error swallowed", 6.0),
        (r"\.catch\s*\(\s*\(\s*\)\s*=>\s*\{\s*\}\s*\)", "Promise .catch with empty handler - swallowed", 6.5),
    ],
    "go": [
        (r"if\s+err\s*!=\s*nil\s*\{[^}]*\}\s*\n\s*//\s*(use|proceed|continue)", "Error checked but execution continues - verify error impact", 5.5),
        (r"_\s*=\s*\w+\.\w+\(", "Discarded error return value - error ignored", 6.0),
    ],
    "java": [
        (r"catch\s*\(\s*(Exception|Throwable)\s+\w+\s*\)\s*\{[^}]*\}", "Broad catch - may swallow security exceptions", 5.5),
        (r"catch\s*\(\s*\w+\s*\)\s*\{\s*(//|/\*|\})", "Empty or comment-only catch block", 6.5),
    ],
    "php": [
        (r"catch\s*\(\s*\\?Exception\s+\$\w+\s*\)\s*\{[^}]*\}", "Broad Exception catch - verify security implications", 5.5),
        (r"@\s*(file_get_contents|unlink|mkdir|fopen|include)", "Error suppression (@) on file operation - errors hidden", 6.0),
    ],
    "ruby/rails": [
        (r"rescue\s*=>\s*\w*\s*\n\s*(nil|#)", "Broad rescue with nil/comment - error swallowed", 6.0),
        (r"rescue\s+StandardError", "Broad StandardError rescue - may swallow auth errors", 5.5),
    ],
    "c/cpp": [
        (r"if\s*\(\s*\w+\s*==\s*NULL\s*\)\s*\{[^}]*goto\s+\w+", "NULL check with goto cleanup - verify all resources freed", 5.5),
        (r"if\s*\(\s*\w+\s*<\s*0\s*\)\s*\{[^}]*return\s", "Error return - check if partially committed state left behind", 5.5),
    ],
}
#: Deserialisation sinks, by language. Fixed values.
DESERIALISATION = {
    "java": [
        (r"ObjectInputStream\s*\(", "Java ObjectInputStream deserialization", 9.0),
        (r"XStream\s*\(\s*\)|xstream\.fromXML|xstream\.unmarshal", "XStream XML deserialization", 8.5),
        (r"XMLDecoder\s*\(", "XMLDecoder bean deserialization", 9.0),
        (r"new\s+Yaml\(\)\.load\s*\(|yaml\.load\s*\(", "SnakeYAML unsafe load", 8.0),
        (r"@JsonTypeInfo\s*\(|enableDefaultTyping\s*\(|activateDefaultTyping\s*\(", "Jackson polymorphic deserialization", 8.0),
        (r"GroovyShell|GroovyClassLoader|groovy\.util\.GroovyScriptEngine", "Groovy script deserialization/eval", 9.8),
        (r"Hessian2Input|HessianProxyFactory|com\.caucho\.hessian", "Hessian2 deserialization", 8.8),
    ],
    "python": [
        (r"pickle\.loads?\s*\(|cPickle\.loads?\s*\(", "Pickle deserialization", 9.0),
        (r"yaml\.load\s*\([^)]*\)", "YAML unsafe load", 8.0, r"\s*.*Loader\s*=\s*(?:yaml\.)?SafeLoader"),
        (r"marshal\.loads?\s*\(", "Marshal deserialization", 8.5),
        (r"shelve\.open\s*\(", "Shelve deserialization", 7.5),
    ],
    "ruby/rails": [
        (r"Marshal\.load\s*\(|Marshal\.restore\s*\(", "Ruby Marshal deserialization", 9.0),
        (r"YAML\.load\s*\([^)]*\)", "Ruby YAML.load (unsafe)", 8.5, r".*safe|.*permitted"),
        (r"PSON\.parse\s*\(|JSON\.load\s*\([^)]*create_additions:\s*true", "Ruby PSON/JSON.create_additions", 8.8),
        (r"ExecJS\.(eval|compile|exec)", "ExecJS SSR eval", 9.0),
    ],
    "php": [
        (r"unserialize\s*\(", "PHP unserialize", 8.5),
        (r"php_var_unserialize|PHP_VAR_UNSERIALIZE", "PHP C extension unserialize", 9.0),
    ],
    "c/cpp": [(r"php_var_unserialize\s*\(", "PHP extension object deserialization", 9.0)],
    "node": [(r"node-serialize|serialize\.unserialize|funcster", "Node.js unsafe deserialization", 9.0)],
    "go": [
        (r"proto\.Unmarshal\s*\(", "Go protobuf unmarshal of untrusted bytes", 7.5),
        (r"gob\.NewDecoder\s*\([^)]*Body|gob\.NewDecoder\s*\(", "Go gob decode of network body", 8.1),
        (r"json\.Unmarshal\s*\([^,]+,\s*&?map\[string\]interface\{\}", "Go json into interface{} map", 6.5),
        (r"plugin\.Open\s*\(", "Go plugin.Open of untrusted path", 8.4),
        (r"yaml\.Unmarshal\s*\(", "Go yaml.Unmarshal of network/config bytes", 7.2),
    ],
}
#: Ways out of a sandbox and up in privilege, any language and case. Fixed values.
BOUNDARIES = [
    (r"(?:/proc/|/sys/|/dev/|/host/|/var/run/docker\.sock|/root/|/home/\w+/\.ssh)", "Host filesystem path reference", 7.5),
    (r"docker\.sock|/var/run/docker|dockerode|Docker\.from_env|docker_client", "Docker socket access", 9.0),
    (r"(?:nsenter|unshare|chroot|pivot_root|setns)\s*\(", "Namespace escape primitive", 8.5),
    (r"(?:CAP_SYS_ADMIN|CAP_NET_ADMIN|CAP_SYS_PTRACE|SYS_RAWIO|CAP_DAC_OVERRIDE)", "Dangerous Linux capability", 8.0),
    (r"(?:process\.env|os\.environ|ENV\[|System\.getenv|getenv\s*\()\s*\[?\s*['\"](?:AWS_|GITHUB_TOKEN|DATABASE_URL|API_KEY|SECRET|PASSWORD|PRIVATE_KEY)", "Sensitive environment variable access", 7.5),
    (r"(?:setuid|seteuid|setreuid|setgid|setegid|chmod\s+[0-7]*[4-7]\d{2})\s*\(", "Privilege escalation primitive", 8.0),
    (r"(?:sudo|su\s+-|doas|runas)\s", "Privilege escalation command", 7.5),
]
#: A check, and a use within the next ten lines, by language. Fixed values.
CHECK_THEN_USE = {
    "c/cpp": [
        (r"\baccess\s*\([^)]+\)", r"\bopen\s*\(", "TOCTOU: access() then open() - symlink race window", 7.5),
        (r"\bstat\s*\([^)]+\)", r"\bopen\s*\(", "TOCTOU: stat() then open() - file may change between calls", 7.0),
        (r"\bstat\s*\([^)]+\)", r"\bfopen\s*\(", "TOCTOU: stat() then fopen() - file may change between calls", 7.0),
        (r"\brealpath\s*\([^)]+\)", r"\bopen\s*\(", "TOCTOU: realpath() then open() - symlink race", 6.5),
        (r"\bchmod\s*\(", r"\bopen\s*\(", "TOCTOU: chmod() then open() - permission race", 6.0),
    ],
    "python": [
        (r"os\.path\.exists\s*\(", r"open\s*\(", "TOCTOU: os.path.exists() then open() - race window", 6.0),
        (r"os\.access\s*\(", r"open\s*\(", "TOCTOU: os.access() then open() - race window", 6.5),
        (r"os\.path\.isfile\s*\(", r"open\s*\(", "TOCTOU: isfile() then open() - race window", 5.5),
    ],
    "node": [
        (r"fs\.existsSync\s*\(", r"fs\.readFileSync\s*\(", "TOCTOU: existsSync then readFileSync - race window", 6.0),
        (r"fs\.access\s*\(", r"fs\.(readFile|writeFile)\s*\(", "TOCTOU: access then read/write - race window", 6.0),
    ],
    "go": [(r"os\.Stat\s*\(", r"os\.(Open|OpenFile)\s*\(", "TOCTOU: os.Stat then os.Open - race window", 6.5)],
    "php": [
        (r"\bfile_exists\s*\(", r"\bfile_get_contents\s*\(", "TOCTOU: file_exists then file_get_contents - race window", 6.0),
        (r"\bis_writable\s*\(", r"\bfile_put_contents\s*\(", "TOCTOU: is_writable then file_put_contents - race window", 6.5),
    ],
    "ruby/rails": [
        (r"File\.exist\?\s*\(", r"File\.(read|open|write|delete|unlink)\s*\(", "TOCTOU: File.exist? then File operation - race window", 6.0),
        (r"File\.symlink\?\s*\(", r"File\.(read|open|write|delete)\s*\(", "TOCTOU: File.symlink? then File operation - symlink race", 6.5),
        (r"File\.stat\s*\(", r"File\.(open|read|write)\s*\(", "TOCTOU: File.stat then File operation", 6.0),
    ],
}
#: Dangerous settings, any case: one row a file and rule, its first line. Fixed values.
SETTINGS = [
    (r"debug\s*[=:]\s*(true|1|yes|on)", "Debug mode enabled", 6.5),
    (r"(cors|allow.origin)\s*[=:]\s*['\"]?\*", "CORS allows all origins", 6.0),
    (r"(ssl|tls|https)\s*[=:]\s*(false|0|disabled|off)", "SSL/TLS disabled", 7.0),
    (r"(verify.ssl|ssl.verify|verify_ssl)\s*[=:]\s*(false|0|no)", "SSL verification disabled", 7.0),
    (r"(secret.key|jwt.secret|app.secret)\s*[=:]\s*['\"]?(change.me|secret|password|default|example)", "Default secret key", 8.0),
    (r"(rate.limit|throttle)\s*[=:]\s*(0|false|disabled|off|none)", "Rate limiting disabled", 5.5),
    (r"(admin|root|superuser)\s*[=:]\s*['\"]?(true|1|yes)", "Admin flag in config", 5.0),
    (r"(password|passwd|secret)\s*[=:]\s*['\"]([^'\"]{1,30})['\"]", "Password in config file", 7.5),
    (r"(bind|listen|host)\s*[=:]\s*['\"]?0\.0\.0\.0", "Binding to all interfaces", 5.0),
    (r"(x.frame.options|x.content.type|x.xss.protection|content.security.policy)\s*[=:]\s*(none|disabled|off|''|\"\")", "Security header disabled", 5.5),
]
#: Settings of composed containers, any case. Fixed values.
COMPOSE = [
    (r"seccomp\s*:\s*unconfined", "Docker: seccomp disabled (unconfined)", 7.0),
    (r"privileged\s*:\s*true", "Docker: Privileged container", 8.0),
    (r"cap_add.*SYS_ADMIN|cap_add.*ALL", "Docker: Dangerous Linux capability", 7.5),
    (r"network_mode\s*:\s*['\"]?host", "Docker: Host network mode", 6.5),
    (r"pid\s*:\s*['\"]?host", "Docker: Host PID namespace", 7.0),
    (r"volumes.*:/var/run/docker.sock|volumes.*/var/run/docker.sock", "Docker: Docker socket mounted", 9.0),
]
#: Flags that a build file should have, and flags that it should not. Fixed values.
HARDENING = [
    ("-fstack-protector-strong", "Stack canary protection missing", 6.0),
    ("-D_FORTIFY_SOURCE", "FORTIFY_SOURCE not set", 5.5),
    ("-fPIE", "Position-Independent Executable flag missing", 5.0),
    ("-Wl,-z,relro", "RELRO not enabled", 5.5),
    ("-Wl,-z,now", "Full RELRO (immediate binding) not enabled", 5.0),
    ("-Wl,-z,noexecstack", "Executable stack not disabled", 5.5),
]
UNSAFE_FLAGS = [
    (r"-O3", "Aggressive optimization -O3 may hide undefined behavior", 4.5),
    (r"-fno-stack-protector", "Stack protector explicitly disabled", 7.5),
    (r"-fno-exceptions", "Exceptions disabled - throws become abort()", 4.0),
    (r"-DNDEBUG", "NDEBUG set - assert() calls are removed in release", 4.0),
]
