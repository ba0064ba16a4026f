"""Rules, advisories, remediations and licence phrases that results depend on, in their order."""

# fmt: off
# ruff: noqa: E501

#: Static-analysis rules: name, severity, file endings, pattern, description.
SAST = (
    ("SQL injection (string interpolation in query)", "HIGH", ".rs .go .py .ts .js .java", r'(?i)(execute|query|raw)\s*\(.*(\+|format!|f"|fmt\.Sprintf|`\$\{)', "User input may flow into SQL query via string concatenation or interpolation"),
    ("SQL injection (format string in query)", "HIGH", ".py .go", r'(?i)(\.query|\.execute|\.raw)\(.*%[sd]', "SQL query uses format string that may include unsanitized input"),
    ("Insecure deserialization (Python pickle)", "HIGH", ".py", r'pickle\.(loads?|Unpickler)\(', "pickle.load/loads can execute arbitrary code from untrusted data"),
    ("Insecure deserialization (Python yaml.load)", "HIGH", ".py", r'yaml\.load\(', "yaml.load without SafeLoader can execute arbitrary code"),
    ("Insecure deserialization (Java ObjectInputStream)", "HIGH", ".java", r'ObjectInputStream|readObject\(\)', "Java deserialization of untrusted data can lead to RCE"),
    ("Insecure deserialization (PHP unserialize)", "HIGH", ".php", r'\bunserialize\s*\(', "PHP unserialize of untrusted data can lead to object injection"),
    ("Path traversal (dot-dot in path operations)", "MEDIUM", ".rs .go .py .ts .js .java", r'(?i)(open|read_to_string|readFile|readFileSync|os\.Open|ioutil\.ReadFile)\s*\(.*\.\.', "File operation with potential path traversal via '..'"),
    ("Path traversal (user input in file path)", "MEDIUM", ".py .ts .js", r'(?i)(req\.params|req\.query|req\.body|request\.form|request\.args)\[.*\].*(?:open|read|write|path\.join)', "User input from request used in file path operations"),
    ("Path traversal (unsanitized path join)", "MEDIUM", ".go .py .ts .js", r'(?:path\.Join|filepath\.Join|path\.join|os\.path\.join)\(.*(?:req|request|params|query|input|user)', "Path join with potentially unsanitized user input"),
    ("Unsafe eval()", "HIGH", ".js .ts .py", r'\beval\s*\(', "eval() executes arbitrary code and should be avoided"),
    ("Unsafe exec()", "HIGH", ".py", r'\bexec\s*\(', "exec() executes arbitrary code and should be avoided"),
    ("Unsafe Function constructor", "HIGH", ".js .ts", r'new\s+Function\s*\(', "Function constructor creates code from strings, similar to eval"),
    ("Dynamic import with variable", "MEDIUM", ".js .ts", r'(?:require|import)\s*\(\s*[a-zA-Z_$]', "Dynamic require/import with non-literal argument may load untrusted modules"),
    ("Unsafe setTimeout/setInterval with string", "MEDIUM", ".js .ts", r"""(?:setTimeout|setInterval)\s*\(\s*['"]""", "setTimeout/setInterval with string argument acts like eval"),
    ("Rust unsafe block", "INFO", ".rs", r'\bunsafe\s*\{', "unsafe block bypasses Rust's safety guarantees — review for soundness"),
    ("Rust unsafe fn", "INFO", ".rs", r'\bunsafe\s+fn\b', "unsafe function requires callers to uphold safety invariants"),
    ("Rust raw pointer dereference", "MEDIUM", ".rs", r'\*(?:const|mut)\s+\w', "Raw pointer usage may lead to undefined behavior if misused"),
    ("JS prototype pollution (direct __proto__)", "HIGH", ".js .ts", r'__proto__', "Direct __proto__ access can enable prototype pollution attacks"),
    ("JS prototype pollution (Object.assign with user input)", "MEDIUM", ".js .ts", r'Object\.assign\s*\(\s*\{\s*\}\s*,.*(?:req|request|body|params|query|input)', "Object.assign with user-controlled input may allow prototype pollution"),
    ("JS prototype pollution (recursive merge)", "MEDIUM", ".js .ts", r'(?:deepMerge|merge|extend|assign)\s*\(.*(?:req|request|body|params|query|input)', "Deep merge with user input may allow prototype pollution"),
    ("Go template injection", "HIGH", ".go", r'template\.(HTML|JS|CSS)\(', "Direct use of template.HTML/JS/CSS bypasses auto-escaping"),
    ("Go weak TLS config", "HIGH", ".go", r'tls\.Config\s*\{[^}]*InsecureSkipVerify\s*:\s*true', "InsecureSkipVerify disables TLS certificate verification"),
    ("Go unhandled error", "MEDIUM", ".go", r'[^,]\s*:?=\s*\w+\.\w+\([^)]*\)\s*$', "Return value (possibly an error) may be silently discarded"),
    ("Shell command with user input", "HIGH", ".go .py .js .ts .java", r'(?:exec\.Command|subprocess\.(?:call|run|Popen)|child_process\.exec|os\.system)\s*\(.*(?:req|request|input|params|query|user|arg)', "Shell command execution with potential user-controlled input"),
    ("JS innerHTML assignment", "HIGH", ".js .ts .jsx .tsx", r'\.innerHTML\s*=', "Direct innerHTML assignment can lead to XSS if input is unsanitized"),
    ("JS document.write", "HIGH", ".js .ts .jsx .tsx", r'document\.write\s*\(', "document.write can inject unsanitized content into the DOM"),
    ("JS dangerouslySetInnerHTML", "HIGH", ".js .ts .jsx .tsx", r'dangerouslySetInnerHTML', "dangerouslySetInnerHTML bypasses React's XSS protection"),
    ("NoSQL injection (MongoDB query with user input)", "HIGH", ".js .ts", r'\.find\s*\(\s*\{.*(?:req\.|request\.|params\.|query\.|body\.)', "MongoDB query built with user input may allow NoSQL injection"),
    ("NoSQL injection ($where operator)", "HIGH", ".js .ts", r'\$where\s*:', "MongoDB $where operator executes JavaScript and is vulnerable to injection"),
    ("JS SSRF (fetch/axios with user input)", "HIGH", ".js .ts", r'(?:fetch|axios\.get|axios\.post|http\.get|https\.get)\s*\(.*(?:req\.|request\.|params|query|body|input|user)', "HTTP request with user-controlled URL may allow SSRF"),
    ("JS weak hash algorithm (MD5/SHA1)", "MEDIUM", ".js .ts", r"""createHash\s*\(\s*['"](?:md5|sha1)['"]""", "MD5/SHA1 are cryptographically weak; use SHA-256 or stronger"),
    ("JS hardcoded JWT secret", "HIGH", ".js .ts", r"""(?:jwt\.sign|jwt\.verify)\s*\([^)]*,\s*['"][^'"]{1,}['"]""", "JWT secret appears hardcoded; use environment variables instead"),
    ("JS permissive CORS (wildcard origin)", "MEDIUM", ".js .ts", r"""(?:Access-Control-Allow-Origin|origin)\s*[:=]\s*['"\*]?\*""", "Wildcard CORS origin allows any domain to make requests"),
    ("JS helmet disabled or missing", "MEDIUM", ".js .ts", r"""app\.disable\s*\(\s*['"]x-powered-by['"]\s*\)""", "Manually disabling x-powered-by; consider using helmet middleware instead"),
    ("JS ReDoS-prone regex", "MEDIUM", ".js .ts", r'new\s+RegExp\s*\(.*(?:req|request|params|query|body|input|user)', "Regex built from user input may allow ReDoS attacks"),
    ("JS Math.random for security", "MEDIUM", ".js .ts", r'Math\.random\s*\(\s*\)', "Math.random() is not cryptographically secure; use crypto.randomBytes()"),
    ("JS child_process.exec (shell injection)", "HIGH", ".js .ts", r'child_process\.exec\s*\(', "child_process.exec uses a shell; prefer execFile or spawn for safety"),
    ("JS disable TLS verification", "HIGH", ".js .ts", r'NODE_TLS_REJECT_UNAUTHORIZED.*=.*0|rejectUnauthorized\s*:\s*false', "Disabling TLS certificate verification exposes the app to MITM attacks"),
    ("JS unvalidated redirect", "MEDIUM", ".js .ts", r'(?:res\.redirect|response\.redirect)\s*\(.*(?:req\.|request\.|params|query|body)', "Redirect with user-controlled URL may allow open redirect attacks"),
    ("Python os.system", "HIGH", ".py", r'os\.system\s*\(', "os.system() executes shell commands and is vulnerable to injection"),
    ("Python subprocess with shell=True", "HIGH", ".py", r'subprocess\.\w+\s*\(.*shell\s*=\s*True', "subprocess with shell=True is vulnerable to shell injection"),
    ("Python os.popen", "HIGH", ".py", r'os\.popen\s*\(', "os.popen() executes shell commands; use subprocess with shell=False"),
    ("Python SQL string formatting", "HIGH", ".py", r"""(?:cursor\.execute|\.execute)\s*\(\s*(?:f['"]|['"].*%[sd]|['"].*\.format)""", "SQL query built with string formatting; use parameterized queries"),
    ("Python SSRF (requests with user input)", "HIGH", ".py", r'requests\.(?:get|post|put|delete|patch)\s*\(.*(?:request\.|form\[|args\[|input|user)', "HTTP request with user-controlled URL may allow SSRF"),
    ("Python weak hash (MD5/SHA1)", "MEDIUM", ".py", r'hashlib\.(?:md5|sha1)\s*\(', "MD5/SHA1 are cryptographically weak; use SHA-256 or stronger"),
    ("Python insecure random", "MEDIUM", ".py", r'\brandom\.(?:random|randint|choice|randrange)\s*\(', "random module is not cryptographically secure; use secrets module"),
    ("Python XML parsing (XXE)", "HIGH", ".py", r'(?:xml\.etree\.ElementTree|xml\.dom\.minidom|xml\.sax)\.parse', "Standard XML parsers may be vulnerable to XXE; use defusedxml"),
    ("Python SSTI (Jinja2 from string)", "HIGH", ".py", r'(?:Template|Environment)\s*\(.*(?:request|input|user|form|args)', "Template rendered from user input may allow server-side template injection"),
    ("Python render_template_string", "HIGH", ".py", r'render_template_string\s*\(', "render_template_string with user input allows SSTI"),
    ("Flask debug mode in production", "HIGH", ".py", r'app\.run\s*\(.*debug\s*=\s*True', "Flask debug mode exposes an interactive debugger; disable in production"),
    ("Django mark_safe with user input", "HIGH", ".py", r'mark_safe\s*\(.*(?:request|input|user|form|args)', "mark_safe with user input bypasses Django's XSS protection"),
    ("Python assert for validation", "MEDIUM", ".py", r'\bassert\s+.*(?:request|input|user|form|password|token|auth)', "assert statements are stripped with -O; do not use for security checks"),
    ("Python hardcoded secret key", "HIGH", ".py", r"""(?:SECRET_KEY|API_KEY|PASSWORD)\s*=\s*['"][^'"]{4,}['"]""", "Secret appears hardcoded; use environment variables instead"),
    ("Python disable SSL verification", "HIGH", ".py", r'verify\s*=\s*False', "Disabling SSL verification exposes the app to MITM attacks"),
    ("Java SQL injection (string concat in query)", "HIGH", ".java", r'(?:createStatement|executeQuery|executeUpdate|execute)\s*\(.*\+', "SQL query built with string concatenation; use PreparedStatement"),
    ("Java Runtime.exec", "HIGH", ".java", r'Runtime\.getRuntime\(\)\.exec\s*\(', "Runtime.exec can execute arbitrary commands; validate all input"),
    ("Java ProcessBuilder with user input", "HIGH", ".java", r'ProcessBuilder\s*\(.*(?:request|getParameter|input|user)', "ProcessBuilder with user-controlled input may allow command injection"),
    ("Java XXE (DocumentBuilderFactory)", "HIGH", ".java", r'DocumentBuilderFactory\.newInstance\(\)', "Default DocumentBuilderFactory is vulnerable to XXE; disable external entities"),
    ("Java XXE (SAXParserFactory)", "HIGH", ".java", r'SAXParserFactory\.newInstance\(\)', "Default SAXParserFactory is vulnerable to XXE; disable external entities"),
    ("Java XXE (XMLInputFactory)", "HIGH", ".java", r'XMLInputFactory\.newInstance\(\)', "Default XMLInputFactory is vulnerable to XXE; disable external entities"),
    ("Java unescaped output in JSP", "HIGH", ".jsp .java", r'<%=.*(?:request\.getParameter|request\.getAttribute)', "Unescaped request parameter in JSP output allows XSS"),
    ("Java SSRF (URL with user input)", "HIGH", ".java", r'new\s+URL\s*\(.*(?:request|getParameter|input|user)', "URL constructed from user input may allow SSRF"),
    ("Java weak cipher (DES/RC4)", "HIGH", ".java", r"""Cipher\.getInstance\s*\(\s*['"](?:DES|RC4|RC2|Blowfish)""", "DES/RC4/RC2/Blowfish are weak ciphers; use AES-256-GCM"),
    ("Java ECB cipher mode", "MEDIUM", ".java", r"""Cipher\.getInstance\s*\(\s*['"]AES/ECB""", "ECB mode does not provide semantic security; use CBC or GCM"),
    ("Java weak hash (MD5/SHA1)", "MEDIUM", ".java", r"""MessageDigest\.getInstance\s*\(\s*['"](?:MD5|SHA-?1)['"]""", "MD5/SHA1 are cryptographically weak; use SHA-256 or stronger"),
    ("Java insecure random (java.util.Random)", "MEDIUM", ".java", r'new\s+Random\s*\(', "java.util.Random is predictable; use SecureRandom for security"),
    ("Java path traversal (File with user input)", "HIGH", ".java", r'new\s+File\s*\(.*(?:request|getParameter|input|user)', "File path from user input without validation allows path traversal"),
    ("Java LDAP injection", "HIGH", ".java", r'(?:search|lookup)\s*\(.*(?:request|getParameter|input|user).*\+', "LDAP query built with user input may allow LDAP injection"),
    ("Java hardcoded password", "HIGH", ".java", r'(?i)(?:password|passwd|secret|apikey)\s*=\s*"[^"]{4,}"', "Password or secret appears hardcoded; use secure configuration"),
    ("Java trust all certificates", "HIGH", ".java", r'TrustAllCerts|X509TrustManager.*checkServerTrusted.*\{\s*\}|ALLOW_ALL_HOSTNAME_VERIFIER', "Trusting all certificates disables TLS verification"),
    ("Java Spring CSRF disabled", "MEDIUM", ".java", r'csrf\(\)\.disable\(\)', "Disabling CSRF protection allows cross-site request forgery attacks"),
    ("Java unvalidated redirect", "MEDIUM", ".java", r'response\.sendRedirect\s*\(.*(?:request|getParameter|input)', "Redirect with user-controlled URL may allow open redirect attacks"),
    ("Java Log injection", "MEDIUM", ".java", r'(?:log|logger)\.(?:info|warn|error|debug)\s*\(.*(?:request\.getParameter|getHeader)', "Logging unsanitized user input may allow log injection/forging"),
    ("PHP eval()", "HIGH", ".php", r'\beval\s*\(', "eval() executes arbitrary PHP code and should be avoided"),
    ("PHP SQL injection (string concat)", "HIGH", ".php", r'(?:mysql_query|mysqli_query|pg_query)\s*\(.*\$_(?:GET|POST|REQUEST|COOKIE)', "SQL query with unsanitized superglobal; use prepared statements"),
    ("PHP system/exec/passthru", "HIGH", ".php", r'\b(?:system|passthru|shell_exec|popen|proc_open)\s*\(', "Shell execution function may allow command injection"),
    ("PHP include with variable", "HIGH", ".php", r'\b(?:include|require|include_once|require_once)\s*\(\s*\$', "Dynamic include with user-controlled path allows local/remote file inclusion"),
    ("PHP XSS (echo with superglobal)", "HIGH", ".php", r'echo\s+.*\$_(?:GET|POST|REQUEST|COOKIE)', "Echoing unsanitized superglobal allows XSS; use htmlspecialchars()"),
    ("PHP extract() on user input", "HIGH", ".php", r'extract\s*\(\s*\$_(?:GET|POST|REQUEST)', "extract() on superglobals can overwrite arbitrary variables"),
    ("PHP disable_functions bypass (preg_replace /e)", "HIGH", ".php", r"""preg_replace\s*\(\s*['"]/.*/e""", "preg_replace with /e modifier executes replacement as PHP code"),
    ("Ruby system/exec/backtick injection", "HIGH", ".rb", r'(?:system|exec|%x)\s*\(.*(?:params|request|input|user)', "Shell execution with user input may allow command injection"),
    ("Ruby send with user input", "HIGH", ".rb", r'\.send\s*\(.*(?:params|request|input|user)', "Dynamic method dispatch via send() with user input allows arbitrary method calls"),
    ("Ruby ERB render from user input", "HIGH", ".rb", r'ERB\.new\s*\(.*(?:params|request|input|user)', "ERB template from user input allows server-side template injection"),
    ("Ruby YAML.load (unsafe)", "HIGH", ".rb", r'YAML\.load\s*\(', "YAML.load can deserialize arbitrary objects; use YAML.safe_load"),
    ("Ruby Marshal.load (unsafe)", "HIGH", ".rb", r'Marshal\.load\s*\(', "Marshal.load can execute arbitrary code from untrusted data"),
    ("Ruby mass assignment (permit!)", "MEDIUM", ".rb", r'\.permit!', "permit! allows all parameters; use explicit permit(:field) instead"),
)

#: Rules of the remediation report, in the same form.
SAST_REMEDIATION = (
    ("SQL injection", "HIGH", ".rs .go .py .ts .js .java", r"""(?i)(execute|query|raw)\s*\(.*(\+|format!|f"|fmt\.Sprintf)""", "User input may flow into SQL query"),
    ("Insecure deserialization (pickle)", "HIGH", ".py", r"pickle\.(loads?|Unpickler)\(", "pickle can execute arbitrary code from untrusted data"),
    ("eval() usage", "HIGH", ".js .ts .py .php", r"\beval\s*\(", "eval() executes arbitrary code"),
    ("innerHTML assignment", "MEDIUM", ".js .ts .tsx .jsx", r"\.innerHTML\s*=", "innerHTML can lead to XSS"),
    ("Weak hash (MD5/SHA1)", "MEDIUM", ".py .java .go .js .ts", r"(?i)(md5|sha-?1)\s*\(", "MD5/SHA1 are cryptographically weak"),
    ("Hardcoded secret", "HIGH", ".py .js .ts .java .rb", r"""(?i)(SECRET_KEY|API_KEY|PASSWORD)\s*=\s*['"][^'"]{4,}['"]""", "Secret appears hardcoded"),
    ("Disabled TLS verification", "HIGH", ".js .ts .py .go", r"(?i)(rejectUnauthorized\s*:\s*false|verify\s*=\s*False|InsecureSkipVerify\s*:\s*true)", "TLS verification is disabled"),
    ("Unsafe block (Rust)", "INFO", ".rs", r"\bunsafe\s*\{", "Unsafe block requires careful review"),
)

#: Rules of the snapshot's counts, in the same form (they have neither names nor descriptions).
SAST_SNAPSHOT = (
    ("", "HIGH", ".rs .go .py .ts .js .java", r"""(?i)(execute|query|raw)\s*\(.*(\+|format!|f"|fmt\.Sprintf)""", ""),
    ("", "HIGH", ".js .ts .py .php", r"\beval\s*\(", ""),
    ("", "HIGH", ".py .js .ts .java", r"""(?i)(SECRET_KEY|API_KEY|PASSWORD)\s*=\s*['"][^'"]{4,}['"]""", ""),
    ("", "MEDIUM", ".js .ts .tsx", r"\.innerHTML\s*=", ""),
    ("", "MEDIUM", ".py .java .go", r"(?i)(md5|sha-?1)\s*\(", ""),
    ("", "INFO", ".rs", r"\bunsafe\s*\{", ""),
)

#: Secrets: name, severity, file endings, pattern, description.
SECRET_FILES = ".go .ts .tsx .js .json .yaml .yml .toml .py .rs .env .cfg .conf .ini"
SECRETS = (
    ("API keys/tokens", "", SECRET_FILES, r"(?i)(password|secret|api_key|apikey|access_token|private_key|SECRET_KEY|AWS_ACCESS|AKIA[0-9A-Z]{16})", ""),
    ("Base64 blobs (potential embedded secrets)", "", SECRET_FILES, r"[A-Za-z0-9+/]{40,}={0,2}", ""),
)
SNAPSHOT_SECRET = r"""(?i)(api[_-]?key|secret[_-]?key|password|passwd|token|auth[_-]?token)\s*[=:]\s*['"][^'"]{8,}['"]"""

#: Dangerous patterns, in the same form.
DANGEROUS = (
    ("SQL injection risk", "", ".go", r"(Exec|Raw|Query)\(.*fmt\.Sprintf|Exec\(.*\+.*\)|Raw\(.*\+.*\)", ""),
    ("Command injection", "", ".go .py .js .ts", r"(exec\.Command|os\.system|subprocess|child_process)\(", ""),
    ("Disabled TLS verification", "", ".go .py .js .ts .yaml .yml", r"(InsecureSkipVerify|NODE_TLS_REJECT_UNAUTHORIZED|verify=False|ssl_verify.*false)", ""),
    ("Weak crypto usage", "", ".go .ts .js .rs", r"\b(md5|sha1|DES|RC4|Math\.random)\b", ""),
    ("CORS wildcard", "", ".go .ts .js .rs .yaml", r"(Access-Control-Allow-Origin.*\*|AllowAllOrigins|cors\.Default)", ""),
    ("Debug/dev flags in production code", "", ".go .ts .yaml .yml .rs", r"(?i)(DEBUG.*=.*true|SWAGGER_ENABLED|devMode|development.*true)", ""),
)

SENSITIVE_PATH = r"(?i)(\.env$|\.env\.|secret|credential|\.key$|\.pem$|\.p12$|\.pfx$|\.jks$|\.keystore$|\.credentials|token)"
SENSITIVE_CHANGE = r"(?i)(auth|login|session|crypto|middleware|permission|authorization)"
SECRET_MESSAGE = r"(?i)(secret|credential|password|api.key|token|leak)"
EMERGENCY_MESSAGE = r"(?i)(revert|hotfix|emergency|rollback)"
FIX_MESSAGE = r"(?i)(fix|bug|broken)"
ADDRESS = r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
ADDRESS_FILES = ".go .ts .tsx .js .yaml .yml .toml .rs .py"
SAFE_ADDRESSES = ("127.0.0.1", "0.0.0.0", "255.255.255.0", "255.255.255.255")
IGNORED_BY_RIGHTS = (".env", "*.key", "*.pem", "*.p12", ".credentials", "*.secret")

#: Advisories: package, ecosystem, affected below, fixed in, id, severity, summary.
ADVISORIES = (
    ("lodash", "npm", "4.17.21", "4.17.21", "CVE-2021-23337", "HIGH", "Command injection via template function"),
    ("minimist", "npm", "1.2.6", "1.2.6", "CVE-2021-44906", "CRITICAL", "Prototype pollution"),
    ("node-fetch", "npm", "2.6.7", "2.6.7", "CVE-2022-0235", "HIGH", "Exposure of sensitive information to an unauthorized actor"),
    ("express", "npm", "4.19.2", "4.19.2", "CVE-2024-29041", "MEDIUM", "Open redirect via URL parsing"),
    ("json5", "npm", "2.2.2", "2.2.2", "CVE-2022-46175", "HIGH", "Prototype pollution in parse()"),
    ("axios", "npm", "1.6.0", "1.6.0", "CVE-2023-45857", "MEDIUM", "CSRF token exposure via XSRF-TOKEN cookie"),
    ("semver", "npm", "7.5.2", "7.5.2", "CVE-2022-25883", "MEDIUM", "Regular expression denial of service"),
    ("requests", "pypi", "2.31.0", "2.31.0", "CVE-2023-32681", "MEDIUM", "Unintended leak of Proxy-Authorization header"),
    ("urllib3", "pypi", "2.0.7", "2.0.7", "CVE-2023-45803", "MEDIUM", "Request body not stripped after cross-origin redirect"),
    ("django", "pypi", "4.2.11", "4.2.11", "CVE-2024-27351", "HIGH", "ReDoS in Truncator.words()"),
    ("flask", "pypi", "2.3.2", "2.3.2", "CVE-2023-30861", "HIGH", "Session cookie set on every response when vary: cookie not set"),
    ("pillow", "pypi", "10.2.0", "10.2.0", "CVE-2023-50447", "CRITICAL", "Arbitrary code execution via PIL.ImageMath.eval"),
    ("jinja2", "pypi", "3.1.3", "3.1.3", "CVE-2024-22195", "MEDIUM", "XSS via xmlattr filter"),
    ("cryptography", "pypi", "42.0.0", "42.0.0", "CVE-2023-49083", "HIGH", "NULL-dereference when loading PKCS7 certificates"),
    ("hyper", "crates.io", "0.14.27", "0.14.27", "CVE-2023-26964", "HIGH", "HTTP/2 peer can cause excessive memory growth"),
    ("regex", "crates.io", "1.5.5", "1.5.5", "CVE-2022-24713", "HIGH", "Regex denial of service"),
    ("openssl", "crates.io", "0.10.48", "0.10.48", "CVE-2023-0286", "HIGH", "X.400 address type confusion in X.509 GeneralName"),
    ("golang.org/x/net", "go", "0.17.0", "0.17.0", "CVE-2023-44487", "HIGH", "HTTP/2 rapid reset attack"),
    ("golang.org/x/crypto", "go", "0.17.0", "0.17.0", "CVE-2023-48795", "MEDIUM", "SSH prefix truncation attack (Terrapin)"),
    ("github.com/gin-gonic/gin", "go", "1.9.1", "1.9.1", "CVE-2023-29401", "HIGH", "Improper handling of non-standard HTTP methods"),
)

#: Remediations: part of a rule's name, guidance, example. The first that fits counts.
REMEDIATIONS = (
    ("SQL injection", "Use parameterized queries instead of string interpolation", "cursor.execute(\"SELECT * FROM users WHERE id = ?\", (user_id,))"),
    ("command injection", "Use subprocess with shell=False and pass arguments as a list", "subprocess.run([\"cmd\", arg1, arg2], shell=False)"),
    ("pickle", "Use json or msgpack for serialization instead of pickle", "data = json.loads(untrusted_input)"),
    ("yaml.load", "Use yaml.safe_load() or specify SafeLoader", "data = yaml.load(stream, Loader=yaml.SafeLoader)"),
    ("ObjectInputStream", "Implement ObjectInputFilter to validate deserialized classes", "ObjectInputFilter.Config.setSerialFilter(filter);"),
    ("eval", "Avoid eval(); use safer alternatives like JSON.parse or AST-based parsing", "const data = JSON.parse(input);"),
    ("innerHTML", "Use textContent for plain text or sanitize with DOMPurify", "element.textContent = userInput; // or DOMPurify.sanitize(html)"),
    ("dangerouslySetInnerHTML", "Sanitize the HTML before rendering with DOMPurify", "dangerouslySetInnerHTML={{ __html: DOMPurify.sanitize(html) }}"),
    ("prototype pollution", "Validate and sanitize object keys; use Object.create(null) for dictionaries", "const safeObj = Object.create(null);"),
    ("path traversal", "Use path.resolve() and verify the result is within an allowed directory", "const resolved = path.resolve(basedir, userInput); if (!resolved.startsWith(basedir)) throw Error();"),
    ("weak hash", "Replace MD5/SHA1 with SHA-256 or stronger", "hashlib.sha256(data).hexdigest()"),
    ("Math.random", "Use crypto.getRandomValues() or crypto.randomBytes() for security-sensitive values", "const token = crypto.randomBytes(32).toString('hex');"),
    ("TLS", "Never disable TLS certificate verification in production", "// Remove NODE_TLS_REJECT_UNAUTHORIZED=0 and rejectUnauthorized: false"),
    ("CORS", "Specify allowed origins explicitly instead of using wildcard", "res.setHeader('Access-Control-Allow-Origin', 'https://trusted.example.com');"),
    ("JWT", "Store JWT secrets in environment variables, never hardcode them", "const secret = process.env.JWT_SECRET; jwt.sign(payload, secret);"),
    ("SSRF", "Validate and allowlist URLs before making requests; block internal IPs", "if (!isAllowedUrl(url)) throw new Error('URL not allowed');"),
    ("XSS", "Sanitize all user input before rendering; use framework auto-escaping", "{{ user_input | escape }}"),
    ("SSTI", "Never pass user input directly to template engines; use sandboxed environments", "env = SandboxedEnvironment(); template = env.from_string(safe_template)"),
    ("debug", "Disable debug mode in production; use environment variables to control", "app.run(debug=os.environ.get('FLASK_DEBUG', 'false') == 'true')"),
    ("unsafe", "Minimize unsafe blocks; document invariants; consider safe abstractions", "// SAFETY: pointer is valid and aligned because ..."),
)

#: Licence texts: identifier, phrases that must all be there, phrases that must not. The first that fits counts.
LICENCE_PHRASES = (
    ("AGPL-3.0", ("gnu affero general public license", "version 3"), ()),
    ("GPL-3.0", ("gnu general public license", "version 3"), ("lesser", "affero")),
    ("GPL-2.0", ("gnu general public license", "version 2"), ("lesser", "affero")),
    ("LGPL-3.0", ("gnu lesser general public license", "version 3"), ()),
    ("LGPL-2.1", ("gnu lesser general public license", "version 2.1"), ()),
    ("MPL-2.0", ("mozilla public license", "version 2.0"), ()),
    ("EPL-2.0", ("eclipse public license", "version 2.0"), ()),
    ("EPL-1.0", ("eclipse public license", "version 1.0"), ()),
    ("Apache-2.0", ("apache license", "version 2.0"), ()),
    ("MIT", ("permission is hereby granted, free of charge", "the above copyright notice and this permission notice"), ()),
    ("ISC", ("permission to use, copy, modify, and/or distribute this software", "isc license"), ()),
    ("BSD-2-Clause", ("redistribution and use in source and binary forms",), ("neither the name",)),
    ("BSD-3-Clause", ("redistribution and use in source and binary forms", "neither the name"), ()),
    ("Unlicense", ("this is free and unencumbered software released into the public domain",), ()),
    ("CC0-1.0", ("cc0 1.0 universal",), ()),
    ("BSL-1.0", ("boost software license",), ()),
    ("0BSD", ("permission to use, copy, modify, and/or distribute this software", "0-clause bsd"), ()),
    ("Zlib", ("the origin of this software must not be misrepresented", "altered source versions must be plainly marked"), ()),
    ("WTFPL", ("do what the fuck you want to public license",), ()),
    ("Artistic-2.0", ("the artistic license 2.0",), ()),
    ("CDDL-1.0", ("common development and distribution license",), ()),
)
LICENCE_HINTS = (
    ("mit license", "MIT"), ("apache license", "Apache-2.0"), ("bsd license", "BSD-3-Clause"),
    ("gnu general public", "GPL"), ("mozilla public", "MPL-2.0"), ("public domain", "Public Domain"),
)
LICENCE_HEADER = r"(?i)SPDX-License-Identifier:\s*(.+)"
#: Categories by upper-case identifier; all others are "unknown".
LICENCE_CATEGORIES = {
    "copyleft (strong)": "AGPL-3.0-ONLY AGPL-3.0-OR-LATER AGPL-3.0 GPL-2.0-ONLY GPL-2.0-OR-LATER GPL-2.0 GPL-3.0-ONLY GPL-3.0-OR-LATER GPL-3.0",
    "copyleft (weak)": "LGPL-2.1-ONLY LGPL-2.1-OR-LATER LGPL-2.1 LGPL-3.0-ONLY LGPL-3.0-OR-LATER LGPL-3.0 MPL-2.0 EPL-1.0 EPL-2.0 CDDL-1.0 CDDL-1.1",
    "permissive": "MIT ISC BSD-2-CLAUSE BSD-3-CLAUSE APACHE-2.0 ZLIB UNLICENSE CC0-1.0 BSL-1.0 0BSD",
}
#: Normal forms of upper-case spellings.
LICENCE_SPELLINGS = (
    ("MIT", "MIT"), ("ISC", "ISC"),
    ("APACHE-2.0", "Apache-2.0"), ("APACHE 2.0", "Apache-2.0"), ("APACHE2", "Apache-2.0"),
    ("BSD-2-CLAUSE", "BSD-2-Clause"), ("BSD2", "BSD-2-Clause"), ("BSD-3-CLAUSE", "BSD-3-Clause"), ("BSD3", "BSD-3-Clause"),
    ("GPL-2.0", "GPL-2.0-only"), ("GPL2", "GPL-2.0-only"), ("GPLV2", "GPL-2.0-only"), ("GPL-2.0-ONLY", "GPL-2.0-only"),
    ("GPL-3.0", "GPL-3.0-only"), ("GPL3", "GPL-3.0-only"), ("GPLV3", "GPL-3.0-only"), ("GPL-3.0-ONLY", "GPL-3.0-only"),
    ("AGPL-3.0", "AGPL-3.0-only"), ("AGPL3", "AGPL-3.0-only"), ("AGPLV3", "AGPL-3.0-only"), ("AGPL-3.0-ONLY", "AGPL-3.0-only"),
    ("LGPL-2.1", "LGPL-2.1-only"), ("LGPL-2.1-ONLY", "LGPL-2.1-only"), ("LGPL-3.0", "LGPL-3.0-only"), ("LGPL-3.0-ONLY", "LGPL-3.0-only"),
    ("MPL-2.0", "MPL-2.0"), ("MPL2", "MPL-2.0"), ("UNLICENSE", "Unlicense"), ("CC0-1.0", "CC0-1.0"), ("CC0", "CC0-1.0"), ("BSL-1.0", "BSL-1.0"),
)

#: Functions and branches by language: file endings, function header, branch patterns.
LANGUAGES = (
    (".rs", r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)",
     (r"\bif\b", r"\belse\s+if\b", r"\bwhile\b", r"\bfor\b", r"\bloop\b", r"\bmatch\b", r"=>", r"&&", r"\|\|", r"\?")),
    (".go", r"^\s*func\s+(?:\([^)]*\)\s+)?(\w+)",
     (r"\bif\b", r"\belse\s+if\b", r"\bfor\b", r"\bcase\b", r"\bselect\b", r"&&", r"\|\|")),
    (".ts .tsx .js .jsx", r"^\s*(?:export\s+)?(?:async\s+)?(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:\([^)]*\)|[^=])\s*=>)",
     (r"\bif\b", r"\belse\s+if\b", r"\bfor\b", r"\bwhile\b", r"\bcase\b", r"\bcatch\b", r"\?\?", r"\?\.\w", r"&&", r"\|\|", r"\?[^?.:}]")),
    (".py", r"^\s*(?:async\s+)?def\s+(\w+)",
     (r"\bif\b", r"\belif\b", r"\bfor\b", r"\bwhile\b", r"\bexcept\b", r"\band\b", r"\bor\b")),
    (".java", r"^\s*(?:public|private|protected|static|final|abstract|synchronized|native)*\s*(?:\w+(?:<[^>]*>)?)\s+(\w+)\s*\(",
     (r"\bif\b", r"\belse\s+if\b", r"\bfor\b", r"\bwhile\b", r"\bcase\b", r"\bcatch\b", r"&&", r"\|\|", r"\?[^?.:}]")),
)
#: The looser header that refactoring hints use for script files; the others are as above.
SCRIPT_HEADER = r"^\s*(?:export\s+)?(?:async\s+)?(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=)"
HINT_KEYWORDS = ("if", "else if", "elif", "for", "while", "loop", "match", "case", "catch", "except")
SNAPSHOT_KEYWORDS = ("if", "else if", "while", "for", "loop", "match", "=>", "&&", "||", "?")
SNAPSHOT_CODE_FILES = ".rs .go .py .ts .js"

#: Hints for complex functions: by value, then by file ending.
HINTS_BY_VALUE = (
    (30, "Consider splitting this function into multiple smaller functions; Extract distinct logical blocks into separate helper functions"),
    (20, "Extract conditional branches into well-named helper functions; Consider using early returns to reduce nesting depth"),
    (10, "Look for repeated patterns that can be extracted into helpers; Consider using guard clauses (early returns) for preconditions"),
)
HINTS_BY_FILE = (
    (".rs", "Consider using match arms with extracted functions"),
    (".py", "Consider using dictionary dispatch instead of long if/elif chains"),
    (".go", "Consider using table-driven tests or switch with extracted functions"),
    (".ts .tsx .js .jsx", "Consider using a strategy/map pattern instead of complex conditionals"),
)

#: Folders at the root of a repository that analyses leave out.
SKIP_SECRETS = ("vendor/", "node_modules/", ".git/")
SKIP_DANGEROUS = ("vendor/", "node_modules/", ".git/", "target/")
SKIP_SENSITIVE = ("vendor/", "node_modules/")
SKIP_CODE = ("vendor/", "node_modules/", ".git/", "target/", "dist/", "build/")
IMPORTING_FILES = ".rs .go .py .ts .tsx .js .jsx .java .rb .php"
# fmt: on
