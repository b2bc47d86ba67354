"""Word lists, patterns and constants that decide the results.

Everything here is data.  The patterns are written for Java's regex engine;
operators add the flag that makes word classes cover all scripts.
"""

# --- stop words of the sentence-aware filter, and the words it always keeps ---
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would shall "
    "should may might must can could in on at to for of and or with as by from "
    "that this it its we you he she they them so if then than into up out about also "
    "very quite really actually basically literally simply highly extremely relatively "
    "mostly usually often certain particular especially specifically generally "
    "some such just me my our your their am i"
).split()

KEEP_WORDS = (
    "not no never none nothing neither nor who what where when why how "
    "more less fewer most least before after during between among"
).split()

# --- the smaller list of the flat filter ---
FLAT_STOP_WORDS = (
    "the a an in it of and or that this was are for on at be by with as we you i he she "
    "they to is been have had has"
).split()

# --- the list of the token-weight filter ---
WEIGHT_STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could "
    "should may might shall can need dare ought used to of in for on with at by from "
    "as into through during before after above below between out off over under again "
    "further then once here there when where why how all each every both few more most "
    "other some such no nor not only own same so than too very just because but and or "
    "if while about up its it this that these those i me my myself we our ours you your "
    "yours he him his she her hers they them their what which who whom also still already "
    "yet even"
).split()

# --- the list ignored by the plain sentence ranking ---
RANK_STOP_WORDS = (
    "the a an is in it of to and or that this was are for on at be by with as not we you "
    "i he she they"
).split()

# --- hedges and filler ---
FILLER_SENTENCES = (
    r"(?i)(Sure[!,.]?\s*|Of course[!,.]?\s*|Certainly[!,.]?\s*|Absolutely[!,.]?\s*"
    r"|No problem[!,.]?\s*|Happy to help[!,.]?\s*)"
)
HEDGES = (
    # softening words
    r"I think|I believe|I guess|I suppose|perhaps|maybe|possibly",
    r"probably|might be|could be|seems like|it appears|sort of|kind of",
    r"more or less|in a way|to some extent|roughly speaking",
    # words that only connect
    r"as you (may |might |probably )?know|it(?:'s| is) worth noting(?: that)?",
    r"(just |simply )?to (be|note|clarify|reiterate|recap|summarize|point out),?",
    r"needless to say,?|it goes without saying(?: that)?",
    r"as (I|we) mentioned( before| earlier| previously)?,?",
    r"at the end of the day,?",
    # courtesies
    r"I hope this helps?\.?|feel free to (ask|reach out|contact us),?",
    r"please (don'?t hesitate|feel free) to (ask|contact|reach out)\.?",
    r"let me know if you (have|need|want) (any|more|further) (questions?|help|information)\.?",
    r"thank(s| you) for (asking|your question|reaching out)\.?",
    # agreement
    r"that(?:'s| is) a (great|good|excellent|wonderful|interesting) (question|point)\.?",
    r"great question[!.]?",
    # openings without content
    r"so basically,?|well, (essentially|basically|actually),?",
    r"honestly,?|truthfully,?|frankly,?|candidly,?",
    r"to be (honest|fair|clear|transparent),?",
    r"as a matter of fact,?|in (actual|actual) fact,?",
)

# --- domain vocabulary: pattern, code ---
VOCABULARY = {
    "business": (
        (r"meeting\s+notes?", "[MTG:NOT]"),
        (r"action\s+items?", "[ACT:ITM]"),
        (r"next\s+steps?", "[NXT:STP]"),
        (r"as\s+soon\s+as\s+possible", "[ASAP]"),
        (r"for\s+your\s+information", "[FYI]"),
        (r"in\s+regards?\s+to", "[RE:]"),
        (r"point\s+of\s+contact", "[POC]"),
        (r"business\s+as\s+usual", "[BAU]"),
        (r"quarter\s+over\s+quarter", "[QoQ]"),
        (r"year\s+over\s+year", "[YoY]"),
        (r"bottom\s+line", "[BL:]"),
        (r"touch\s+base", "[SYNC]"),
        (r"deep\s+dive", "[ANL:DRIL]"),
        (r"value\s+add(?:ed)?", "[VAL+]"),
        (r"low\s+hanging\s+fruit", "[EASY:WIN]"),
        (r"move\s+the\s+needle", "[IMPV:KPI]"),
        (r"bandwidth", "[CAP]"),
        (r"circle\s+back", "[FLW:UP]"),
        (r"pivot", "[CHNG:DIR]"),
        (r"scale\s+(?:up|out)", "[SCALE+]"),
    ),
    "governance": (
        (r"service\s+level\s+agreement", "[SLA]"),
        (r"key\s+performance\s+indicators?", "[KPI]"),
        (r"standard\s+operating\s+procedures?", "[SOP]"),
        (r"return\s+on\s+investment", "[ROI]"),
        (r"technical\s+specifications?", "[TECH:SPC]"),
        (r"reed\s+of\s+risk", "[RISK:POL]"),
        (r"data\s+protection\s+officer", "[DPO]"),
        (r"general\s+data\s+protection\s+regulation", "[GDPR]"),
        (r"compliance\s+officer", "[CO]"),
        (r"audit\s+trail", "[AUD:LOG]"),
    ),
    "devops": (
        (r"continuous\s+integration", "[CI]"),
        (r"continuous\s+deployment", "[CD]"),
        (r"pull\s+request", "[PR]"),
        (r"code\s+review", "[CR]"),
        (r"infrastructure\s+as\s+code", "[IaC]"),
        (r"load\s+balancer", "[LB]"),
        (r"rate\s+limiting", "[RL]"),
        (r"application\s+programming\s+interface", "[API]"),
        (r"microservices?\s+architecture", "[MSA]"),
        (r"kubernetes", "[K8s]"),
        (r"docker", "[DKR]"),
        (r"database", "[DB]"),
        (r"authentication", "[AUTH]"),
        (r"authorization", "[AUTHZ]"),
        (r"endpoint", "[EP]"),
    ),
    "finance": (
        (r"earnings\s+before\s+interest\s+and\s+taxes", "[EBIT]"),
        (r"gross\s+domestic\s+product", "[GDP]"),
        (r"accounts?\s+receivable", "[AR]"),
        (r"accounts?\s+payable", "[AP]"),
        (r"profit\s+and\s+loss", "[P&L]"),
        (r"operating\s+expenses?", "[OPEX]"),
        (r"capital\s+expenditures?", "[CAPEX]"),
        (r"cash\s+flow", "[C/F]"),
        (r"business\s+development", "[BIZ:DEV]"),
    ),
}

# --- polite phrases, each replaced by a blank ---
POLITE_PHRASES = (
    r"\bplease\b[\s,]*",
    r"\bcould you\b[\s,]*",
    r"\bwould you\b[\s,]*",
    r"\bcan you\b[\s,]*",
    r"\bfeel free to\b[\s]*",
    r"\blet me know\b[\s,]*(?:if[^.]*)?",
    r"\bthank(?:s| you)[^.]*?\.",
    r"\bI hope this (?:helps|answer)[^.]*?\.",
    r"\bof course\b[\s,]*",
    r"\bcertainly\b[\s,]*",
    r"\babsolutely\b[\s,]*",
    r"\bI(?:'d| would) be happy to\b[\s,]*",
    r"\bAs an AI\b[^.]*?\.",
    r"\bIt(?:'s| is) important to (?:note|mention) that\b[\s,]*",
)

# --- shorthand: phrase, short form ---
SHORTHAND = (
    ("in order to", "to"),
    ("due to the fact that", "because"),
    ("at this point in time", "now"),
    ("for the purpose of", "for"),
    ("in the event that", "if"),
    ("with regard to", "re:"),
    ("with respect to", "re:"),
    ("a number of", "several"),
    ("the majority of", "most"),
    ("it is possible that", "maybe"),
    ("initialize", "init"),
    ("terminate", "end"),
    ("execute", "run"),
    ("generate", "gen"),
    ("parameter", "param"),
    ("configuration", "cfg"),
    ("authentication", "auth"),
    ("authorization", "authz"),
    ("temperature", "temp"),
    ("database", "db"),
    ("repository", "repo"),
    ("application", "app"),
)

# --- output clean-up and paraphrase markers ---
OUTPUT_CLEANUP = (
    (r"^(Of course|Sure|Certainly|Absolutely)[!.]?\s*", ""),
    (r"\bin order to\b", "to"),
    (r"\b(as previously mentioned|as stated above|as noted earlier)\b", ""),
)
PARAPHRASE_MARKERS = (
    r"\b(in other words|to rephrase|to put it differently|that is to say|to clarify|"
    r"to be more specific|in (simpler|plain|other) terms),?\s*"
)

# --- signal vocabulary by cluster ---
SIGNAL_CLUSTERS = {
    "api_tech": "api endpoint token request response header payload auth oauth webhook rest "
                "graphql grpc http https json xml schema parsing client server protocol".split(),
    "infra": "server database cache queue broker stream kubernetes docker container deployment "
             "pipeline cluster node service gateway proxy balancer replica shard".split(),
    "model_ai": "model inference embedding context prompt completion latency throughput accuracy "
                "precision recall training llm neural feature vector attention transformer".split(),
    "business": "cost revenue savings roi kpi metric performance efficiency value impact priority "
                "deadline budget risk compliance audit sla contract forecast target".split(),
    "analytics": "data result analysis report trend percentage ratio rate increase decrease growth "
                 "comparison benchmark statistic measurement correlation variance sample".split(),
    "status": "error failure success warning critical status issue bug fix resolution incident "
              "alert anomaly timeout retry fallback degraded crash exception".split(),
    "action": "implement deploy configure optimize migrate refactor monitor test debug update "
              "upgrade install remove create delete review approve block enable disable".split(),
}
SIGNAL_SUBSTRINGS = (
    "result shows analysis impact increase decrease achieve conclude found data value cost "
    "performance failure success model api token study evidence key"
).split()

# --- entity anchors: a sentence matching one is kept ---
ENTITY_ANCHORS = {
    # The repeat is possessive: it runs in a loop, where a plain one recurses once per word.
    "proper_noun": r"\b[A-Z][a-z]{2,}\b(?:\s+[A-Z][a-z]{2,}\b)*+",
    "percent": r"\b\d+(?:\.\d+)?(?:\s*%|\s*x\b|\s*times?\b)",
    "currency": r"\b\$\s*[\d,]+(?:\.\d{2})?\b",
    "year": r"\b(?:19|20)\d{2}\b",
    "date": r"\b\d{1,2}(?:/\d{1,2}/\d{2,4}|\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec))\b",
    "url": r"https?://\S+",
    "acronym": r"\b[A-Z0-9]{2,6}\b",
    "comparative": r"\b(?:more|less|greater|fewer|higher|lower)\s+than\s+\d",
    "fiscal_period": r"\b(?:Q[1-4]|H[12]|FY)\s*\d{4}\b",
}

# --- opcode groups: pattern, replacement.  <U>..</U> is upper-cased, <S>..</S> is trimmed ---
OPCODE_COMMANDS = (
    (r"\b(?:please|kindly|can you|could you|would you)?\s*"
     r"(summarize|analyze|analyse|fix|debug|check|write|create|generate|build|"
     r"optimize|refactor|explain|describe|translate|convert|review|test|deploy|"
     r"configure|implement|design|update|remove|delete|document|parse|format)"
     r"\s+(?:the\s+|this\s+|my\s+|our\s+|a\s+)?([\w\s]{2,40}?)(?=[.!?,]|$)",
     "[DO:<U>$1</U>(<S>$2</S>)]"),
    (r"\b(?:I|we)\s+(?:want|need|require|must)\s+(?:to|you to)?\s*(\w+)\s+([\w\s]{2,40}?)(?=[.!?,]|$)",
     "[NEED:<U>$1</U>(<S>$2</S>)]"),
    (r"\bwhat\s+(?:is|are|was|were)\s+(.{3,60}?)\?", "[ASK:<S>$1</S>]"),
    (r"\bhow\s+(?:do|can|should|does|to)\s+(?:I|we|one|you)?\s*(.{3,60}?)\?", "[HOW:<S>$1</S>]"),
    (r"\bwhy\s+(?:is|are|does|do|did|was|were)\s+(.{3,60}?)\?", "[WHY:<S>$1</S>]"),
)
OPCODE_QUANTITIES = (
    (r"\b(\d+(?:\.\d+)?)\s*(?:tokens?|milliseconds?|ms|seconds?|minutes?|hours?|days?)\b", "[N:$0]"),
    (r"\b(?:more|greater|higher|larger)\s+than\s+(\d[\w.]*)", "[CMP:>$1]"),
    (r"\b(?:less|fewer|lower|smaller)\s+than\s+(\d[\w.]*)", "[CMP:<$1]"),
    (r"\b(?:approximately|about|roughly|around|~)\s+(\d[\w.]*)", "[~$1]"),
)
OPCODE_CONDITIONS = (
    (r"\bif\s+(.{5,60}?)\s*,?\s*(?:then)?\s+(.{5,60}?)(?=[.!?]|$)", "[IF:<S>$1</S>→<S>$2</S>]"),
    (r"\bunless\s+(.{5,50}?)(?=[.,!?]|$)", "[UNLESS:<S>$1</S>]"),
    (r"\bwhen(?:ever)?\s+(.{5,50}?)(?=[.,!?]|$)", "[WHEN:<S>$1</S>]"),
)
OPCODE_CAUSALITY = (
    (r"\b(?:because|due to|since|as a result of|owing to|on account of)\b", "[CAU]"),
    (r"\b(?:therefore|consequently|as a result|thus|hence|accordingly|so)\b", "[RES]"),
    (r"\b(?:however|but|although|nevertheless|on the other hand|in contrast|yet|despite)\b", "[CON]"),
    (r"\b(?:for example|e\.g\.|for instance|such as|including|like)\b", "[EG:]"),
    (r"\b(?:in addition|furthermore|moreover|additionally|also|and moreover)\b", "[ADD]"),
    (r"\b(?:in conclusion|to summarize|in summary|to conclude|overall|in short)\b", "[SUM]"),
)
OPCODE_TEMPORAL = (
    (r"\b(?:yesterday|last\s+(?:week|month|year|quarter|sprint|iteration))\b", "[T:PAST]"),
    (r"\b(?:currently|at the moment|right now|today|at present|now)\b", "[T:NOW]"),
    (r"\b(?:tomorrow|next\s+(?:week|month|year|quarter|sprint)|soon|upcoming|in the future)\b", "[T:NEXT]"),
    (r"\b(?:immediately|urgently|asap|right away|without delay)\b", "[T:ASAP]"),
)
OPCODE_STATUS = (
    (r"\bthe\s+(?:api|service|endpoint|server)\s+(?:returned|sent|threw|raised)\s+(?:an?\s+)?"
     r"(?:error|exception|fault)\b\s*(\d*)", "[SVC:ERR($1)]"),
    (r"\b(?:error|exception|failure)\s+(?:code|type|num|number)?\s*[:=]?\s*(\w+)", "[ERR:$1]"),
    (r"\bstatus\s*[:=]\s*(\w+)", "[ST:<U>$1</U>]"),
    (r"\b(\d+(?:\.\d+)?)\s*%\s+(?:reduction|improvement|increase|decrease|growth|drop|gain)", "[Δ:$1%]"),
    (r"\b(?:timed?\s+out|timeout|connection\s+(?:refused|reset|failed))\b", "[ERR:TIMEOUT]"),
    (r"\b(?:rate\s+limit(?:ed)?|throttl(?:ed|ing))\b", "[ERR:RATELIMIT]"),
)
OPCODE_GROUPS = (
    ("commands", OPCODE_COMMANDS),
    ("quantities", OPCODE_QUANTITIES),
    ("conditions", OPCODE_CONDITIONS),
    ("causality", OPCODE_CAUSALITY),
    ("temporal", OPCODE_TEMPORAL),
    ("status", OPCODE_STATUS),
)
_OPCODE_VERBS = ("summarize analyze analyse fix debug check write create generate build optimize refactor explain describe translate "
                 "convert review test deploy configure implement design update remove delete document parse format").split()
# Of each pattern above, in order, the words of which a text must have one for a match; a run of a-z counts as a word, what is
# no letter may be anywhere.  The words that may come before a verb can be one run with it.
OPCODE_NEEDS = dict(zip((pattern for _, group in OPCODE_GROUPS for pattern, _ in group), (
    (*_OPCODE_VERBS, *(lead + verb for lead in ("please", "kindly", "you") for verb in _OPCODE_VERBS)),
    ("want", "need", "require", "must"), ("what",), ("how",), ("why",),
    ("token", "tokens", "millisecond", "milliseconds", "ms", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days"),
    ("more", "greater", "higher", "larger"), ("less", "fewer", "lower", "smaller"), ("approximately", "about", "roughly", "around", "~"),
    ("if",), ("unless",), ("when", "whenever"),
    ("because", "due", "since", "result", "owing", "account"),
    ("therefore", "consequently", "result", "thus", "hence", "accordingly", "so"),
    ("however", "but", "although", "nevertheless", "hand", "contrast", "yet", "despite"),
    ("example", "g", "instance", "such", "including", "like"),
    ("addition", "furthermore", "moreover", "additionally", "also"),
    ("conclusion", "summarize", "summary", "conclude", "overall", "short"),
    ("yesterday", "last"), ("currently", "moment", "now", "today", "present"), ("tomorrow", "next", "soon", "upcoming", "future"),
    ("immediately", "urgently", "asap", "away", "delay"),
    ("api", "service", "endpoint", "server"), ("error", "exception", "failure"), ("status",), ("%",),
    ("time", "timed", "timeout", "connection"), ("rate", "throttled", "throttling"),
), strict=True))
OPCODE_INNER_STOPS = (
    r"\b(the|a|an|is|are|was|were|that|this|it|its|to|of|for|in|on|at|by|with|from|and|or|but|"
    r"be|been|being|so|if|then|there|which|who|have|has|had|will|would|should|could|may|might|"
    r"can|shall)\b"
)
# Marks that readers of the compact text look for.
OPCODE_PREFIX = "[NEX.NL] "
OPCODE_MARK = "[NEX"
SYMBOL_HEADER = "[NEX.CODE.V2]\n"
# Fixed value: system messages holding this text are left as they are.
EXEMPT_MARKER = "NEX Bytecode"

# --- long quotes ---
QUOTE_CODE = r"[{}();=<>]|def |class |import "

# --- chunk selection ---
ACTION_WORDS = r"\b(must|should|required|critical|important|ensure|implement|configure)\b"
TITLE_PHRASE = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+\b)++"
ALIAS_PHRASE = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,4})\b"

# --- content class: pattern, weight ---
CODE_WEIGHTS = (
    (r"\b(def|class|import|from|return|async|await|yield)\s", 2.0),
    (r"\b(function|const|let|var|=>|require|export)\s", 2.0),
    (r"\b(public|private|protected|static|void|int|string)\s", 2.0),
    (r"\b(SELECT|INSERT|UPDATE|DELETE|FROM|WHERE|JOIN)\b", 2.0),
    (r"[{}\[\]();]", 0.3),
    (r"^\s{2,}", 0.5),
    (r"^\s*(#|//|/\*|\*)", 0.8),
    (r"[a-zA-Z_]\w*\(.*?\)", 0.6),
    (r"[a-zA-Z_]\w*\.[a-zA-Z_]", 0.4),
    (r"(==|!=|<=|>=|&&|\|\||::|->)", 0.7),
    (r"(Traceback|Exception|Error|at\s+\w+\.\w+\()", 1.5),
    (r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}", 1.0),
    (r"(WARN|INFO|DEBUG|ERROR|FATAL)\s", 1.0),
)
PROSE_WEIGHTS = (
    (r"\b(please|could you|would you|can you|I need|help me)\b", 2.0),
    (r"\b(the|a|an|is|are|was|were|has|have|had)\b", 0.3),
    (r"[.!?]\s+[A-Z]", 0.5),
    (r"\b(however|therefore|furthermore|additionally|moreover)\b", 1.5),
    (r"\b(analyze|explain|summarize|describe|compare)\b", 1.0),
)
CODE_THRESHOLD = 0.55
TRACE_INDICATORS = (
    r"Traceback \(most recent call last\)",
    r"^\s+at\s+\w+",
    r'^\s+File ".*", line \d+',
    r"Exception:|Error:",
    r"^\s+\d+\s+\|",
)
LOG_LINE = (
    r"^\d{4}[-/]\d{2}[-/]\d{2}|^(WARN|INFO|DEBUG|ERROR|FATAL|TRACE)\s|"
    r"^\[\d{4}[-/]\d{2}[-/]\d{2}"
)
LOG_HEAD_LINE = (
    r"^\d{4}[-/]\d{2}[-/]\d{2}|^(WARN|INFO|DEBUG|ERROR|FATAL)\s|"
    r"^\[.*?\]\s+(WARN|INFO|DEBUG|ERROR|FATAL)"
)
PYTHON_INDICATORS = (
    r"^\s*def\s+\w+\s*\(", r"^\s*class\s+\w+", r"^\s*import\s+",
    r"^\s*from\s+\w+\s+import", r":\s*$", r"^\s*if\s+.*:$",
)
SCRIPT_INDICATORS = (
    r"\bfunction\s+\w+", r"\bconst\s+", r"\blet\s+", r"\bvar\s+",
    r"=>", r"\brequire\(", r"\bexport\s+",
)

# --- routing ---
COMPLEX_KEYWORDS = (
    r"\bcalculate\b", r"\bderive\b", r"\bprove\b", r"\bintegrate\b", r"\bdifferential\b",
    r"\bequation\b", r"\balgorithm\b", r"\boptimize\b", r"\brefactor\b", r"\barchitect\b",
    r"\bdesign pattern\b", r"\bunified\b", r"\bquantum\b", r"\bcryptograph\b",
    r"\bcomplex\b", r"\banalyze\b",
)
COMPLEX_TAGS = ("[HEAVY]", "[COMPLEX]")
COMPLEX_WORDS = 2000
UNCERTAINTY = (
    (r"\bI think\b", 0.15), (r"\bI believe\b", 0.12), (r"\bpossibly\b", 0.15),
    (r"\bperhaps\b", 0.15), (r"\bmaybe\b", 0.15), (r"\bnot sure\b", 0.20),
    (r"\bI don't know\b", 0.30), (r"\bunsure\b", 0.20),
)
CONFIDENCE_THRESHOLD = 0.7
TIER_SIGNALS = (
    "derivative", "integral", "proof", "algorithm", "theorem", "multi-step",
    "explain in detail", "synthesize", "complex", "matrix", "differential", "quantum",
    "tensor", "infer",
)
TIER_SIGNALS_LONG = TIER_SIGNALS[:6] + ("reason why",) + TIER_SIGNALS[6:]
TIER_MODELS = {1: "DeepSeek V3", 2: "Gemini 1.5 Pro"}
REGION_PATTERNS = (
    ("eu-central", r"^(?:5\.(?:2[56789]|[34]\d))"),
    ("eu-central", r"^(?:46\.(?:2[0-9]{2}))"),
    ("eu-central", r"^(?:193\.(?:1\d{2}))"),
    ("eu-west", r"^(?:51\.)"),
    ("eu-west", r"^(?:52\.)"),
)
DEFAULT_REGION = "eu-central"
# family, model, temperature, top_p, top_k, max_tokens, rpm, tpm, rpd, is_default
MODEL_CONFIGS = (
    ("deepseek", "deepseek-chat", 0.3, 0.9, None, 4096, 100, 100000, None, True),
    ("deepseek", "deepseek-coder", 0.1, 0.95, None, 8192, 50, 50000, None, False),
    ("gemini", "gemini-1.5-pro", 0.4, 0.95, 40, 8192, 360, 2000000, 10000, False),
    ("gemini", "gemini-1.5-flash", 0.2, 0.8, 40, 2048, 2000, 1000000, None, True),
)

# --- security ---
BLOCKED_PATTERNS = (
    r";\s*DROP\s+", r";\s*DELETE\s+FROM\s+", r";\s*TRUNCATE\s+",
    r";\s*ALTER\s+", r";\s*CREATE\s+", r"UNION\s+SELECT",
    r"--\s*$",
    r"\.\./|\.\.\\", r"/etc/passwd", r"/etc/shadow",
    r"%2e%2e", r"%252e%252e",
    r";\s*(?:rm|sudo|chmod|chown|kill|shutdown|reboot)\s",
    r"\$\(", r"`[^`]*`",
    r"\|\s*(?:bash|sh|zsh|cmd|powershell)",
    r"<script[^>]*>", r"javascript:", r"eval\s*\(",
)
EGRESS_RULES = (
    r"As per the AST compression rules[^.]*\.",
    r"(?i)NEX (semantic|bytecode|pipeline|compression)[^.]*\.",
    r"(?i)(as instructed|per (my|the) (system|instructions?))[^.]*\.",
    r"(?m)^Note:\s.*$",
)
KEY_PREFIX = "fk-"

# --- cache ---
CACHE_SIMILARITY = 0.85
CACHE_REGEN_WEIGHT = 0.001
CACHE_MISMATCH_WEIGHT = 10.0
EMBEDDING_BUCKETS = 128

# --- logs ---
LOG_LEVEL = r"\b(ERROR|WARN|INFO|DEBUG|FATAL|TRACE)\b"
LOG_LEVELS = ("ERROR", "WARN", "INFO", "DEBUG", "FATAL", "TRACE")
IMPORTANT_LINE = r"(?i)\b(error|fail|exception|critical|warning|timeout|refused|denied)\b"
