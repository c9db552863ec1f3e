"""Vocabularies. Every operator takes its vocabulary as a parameter; these are the defaults."""

from __future__ import annotations

# Word lists, patterns and formats that results depend on.
SKILLS = [
    "python", "java", "javascript", "typescript", "go", "rust", "c++",
    "react", "vue", "angular", "node.js", "django", "flask", "fastapi",
    "aws", "gcp", "azure", "docker", "kubernetes", "terraform",
    "postgresql", "mysql", "mongodb", "redis", "git", "ci/cd", "agile", "scrum",
    "machine learning", "deep learning", "nlp", "computer vision", "data science", "sql", "nosql",
]
LOCATION_ALIASES = {
    "usa": "United States|USA|U.S.",
    "japan": "Japan|Tokyo|Osaka|Kyoto",
    "china": "China|Shanghai|Beijing|Shenzhen",
    "uk": "United Kingdom|UK|London",
    "germany": "Germany|Berlin|Munich",
    "france": "France|Paris",
}
CATEGORIES = {
    "Engineering": ["engineer", "developer", "software", "tech", "backend", "frontend", "fullstack", "infrastructure"],
    "Product": ["product manager", "pm", "product owner"],
    "Design": ["design", "ux", "ui", "product designer"],
    "Marketing": ["marketing", "growth", "seo", "brand"],
    "Sales": ["sales", "account executive", "ae", "business development"],
    "Finance": ["finance", "accounting", "tax", "treasury"],
    "Legal": ["legal", "law", "counsel", "compliance"],
    "People": ["people", "hr", "recruiting", "talent"],
    "AI": [
        "ai engineer", "artificial intelligence", "machine learning", "deep learning", "computer vision", "nlp",
        "natural language", "llm", "generative ai", "gpt", "ai architect", "ml engineer", "ml ops", "mlops",
        r"\bml\b", r"\bai\b",
    ],
}
IT_ROLES = [
    r"\bsoftware\b", r"\bengineer\b", r"\bdeveloper\b", r"\bdev\b", r"\bfrontend\b", r"\bbackend\b", r"\bfullstack\b",
    r"\bdata\b", r"\bscientist\b", r"\banalyst\b", r"\bmachine\s+learning\b", r"\bml\b", r"\bai\b", r"\bartificial\b",
    r"\bnlp\b", r"\bdevops\b", r"\bsre\b", r"\bsite\s+reliability\b", r"\binfrastructure\b", r"\bcloud\b",
    r"\bsecurity\b", r"\bcyber\b", r"\barchitect\b", r"\bproduct\b", r"\bpm\b", r"\bdesigner\b", r"\bux\b", r"\bui\b",
    r"\bqa\b", r"\bquality\b", r"\btesting\b", r"\bautomation\b", r"\bmobile\b", r"\bandroid\b", r"\bios\b",
    r"\bswift\b", r"\bkotlin\b", r"\bembedded\b", r"\bfirmware\b", r"\bhardware\b", r"\bsystem\b", r"\badmin\b",
    r"\btech\b", r"\btechnical\b", r"\bresearcher\b", r"\bspecialist\b", r"\bplatform\b", r"\breliability\b",
    r"\bobservability\b", r"\bcryptography\b", r"\bblockchain\b", r"\bweb3\b", r"\bdatabase\b", r"\bsql\b",
    r"\big\s+data\b", r"\bdistributed\b", r"\bperformance\b", r"\btools\b", r"\bintern\b", r"\bstaff\b",
    r"\bprincipal\b", r"\blead\b", r"\bhead\b", r"\bvp\b", r"\bcto\b",
]
NON_IT_TITLES = [
    r"\bsales\b", r"\bmarketing\b", r"\bcustomer\s+success\b", r"\baccount\s+manager\b",
    r"\bhuman\s+resources\b", r"\bhr\b", r"\brecruiting\b", r"\brecruiter\b", r"\bfinance\b",
    r"\blegal\b", r"\baccountant\b", r"\bauditor\b", r"\bpayroll\b", r"\bworkplace\b",
    r"\bfacilities\b", r"\boffice\s+manager\b", r"\badministrator\b", r"\breceptionist\b",
    r"\bclerk\b", r"\boperator\b", r"\blogistics\b", r"\bwarehouse\b", r"\bsupply\s+chain\b",
    r"\btreasury\b", r"\btax\b", r"\bpublic\s+relations\b", r"\bcomms\b", r"\bcommunications\b",
]
LANGUAGE_REQUIRED = [
    "jlpt", "n1", "n2", "n3", r"japanese[:\s]+business", r"japanese[:\s]+fluent", r"native[:\s]+japanese",
    r"fluent[:\s]+japanese", r"business[:\s]+level[:\s]+japanese", "日本語", "ビジネスレベル", "ネイティブレベル", "流暢",
    r"japanese\s+proficiency", r"must\s+speak\s+japanese", r"requirement[:\s]+japanese",
]
LANGUAGE_OK = [
    r"no\s+japanese\s+required", r"japanese\s+not\s+required", r"english\s+only", r"english-only",
    r"working\s+language\s+is\s+english", r"primary\s+language\s+is\s+english",
]
#: Patterns that results depend on: pay ranges (digits before the first comma, all digits), curated and numbered lines, data in pages.
SALARY = r"\$(\d+)(?:,\d{3})*(?:k|K)?\s*-\s*\$(\d+)(?:,\d{3})*(?:k|K)?"
SALARY_WHOLE = r"\$(\d+(?:,\d{3})*)(?:k|K)?\s*-\s*\$(\d+(?:,\d{3})*)(?:k|K)?"
CURATED = r"^\d+\)\s+(.+?)\s+[-–—]\s+(.+?)\s+\((.+?)\)\s*$"
NUMBERED = r"^\d+\)\s+(.+?)\s+-"
EMBEDDED = r"(?is)<script[^>]*__NEXT_DATA__[^>]*>(.*?)</script>"
#: The board's token in URLs and configured endpoints, by vendor.
GREENHOUSE_URL, GREENHOUSE_ENDPOINT = r"greenhouse\.io/(?:embed/job_board\?for=)?([^/?&]+)", "boards/([^/]+)"
WORKABLE_URL, WORKDAY_URL = r"workable\.com/+([^/]+)", r"https://[^/]+/([^/.]+)"
LAST_PART, LEVER_ENDPOINT = r"([^/]+)$", r"lever\.co/([^/?]+)"
#: Vendors by URL pattern, in order of priority.
VENDORS = [
    ("greenhouse", r"boards?\.greenhouse\.io"),
    ("lever", r"jobs\.lever\.co"),
    ("ashby", r"jobs\.ashbyhq\.com"),
    ("workable", r"apply\.workable\.com"),
    ("breezy", r"\.breezy\.hr"),
    ("workday", r"myworkdayjobs\.com"),
]
#: What the pages of some vendors' boards hold, by vendor in order of priority.
VENDOR_LINKS = [("greenhouse", r"boards\.greenhouse\.io|grnh\.se"), ("lever", r"jobs\.lever\.co"), ("workday", r"myworkdayjobs\.com")]
VENDOR_MARKERS = [("greenhouse", ["#application", ".opening"]), ("lever", [".posting", ".posting-headline"]), ("workday", [".jobProperty", "workday"])]
#: Substrings of a board's URL that choose its adapter, in order.
ADAPTERS = [
    ("greenhouse.io", "greenhouse"),
    ("lever.co", "lever"),
    ("workday.com", "workday"),
    ("myworkdayjobs.com", "workday"),
    ("ashbyhq.com", "ashby"),
    ("workable.com", "workable"),
    ("wellfound.com", "wellfound"),
]
CAREER_WORDS = ["careers", "jobs", "join us", "hiring", "work with us", "open positions", "openings", "team"]
VAGUE_LOCATIONS = ["hybrid", "remote", "on-site", "onsite"]
LEGAL_SUFFIXES = [r"\s+Inc\.?$", r"\s+LLC\.?$", r"\s+Ltd\.?$", r"\s+Corp\.?$", r"\s+Corporation$", r"\s+Co\.?$"]
CURATED_SUFFIXES = [
    "Inc.", "Inc", "LLC", "Ltd.", "Ltd", "Company", "Co.", "Corporation", "Corp.", "Corp", "Technologies", "Tech",
]
SLUG_TLDS = ["com", "co", "jp", "net", "org", "ai", "io", "ne"]
SLUG_GENERIC = ["www", "careers", "jobs", "global", "corporate"]
PROBES = [
    ("https://jobs.ashbyhq.com/%s", "ashby"),
    ("https://boards.greenhouse.io/%s", "greenhouse"),
    ("https://jobs.lever.co/%s", "lever"),
    ("https://apply.workable.com/%s", "workable"),
    ("https://%s.breezy.hr", "breezy"),
]
HIGH_SIGNAL = [
    "ai platform", "genai", "generative ai", "llm", "rag", "cloud architect", "solution architect", "platform engineer",
    "mlops", "ml platform", "enterprise ai", "ai infrastructure", "kubernetes", "terraform", "distributed systems",
    "staff engineer", "principal engineer",
]
EXCLUDED = [
    "cuda", "nccl", "rdma", "gpu kernel", "data scientist", "data analyst", "junior", "entry level", "qa engineer",
    "test engineer", "phd required", "kernel engineer",
]
TEST_WORDS = ["test", "demo", "sample", "example"]
CAREER_PATHS = [
    "/careers", "/jobs", "/career", "/join-us", "/work-with-us", "/opportunities", "/job-openings", "/employment",
    "/hiring", "/join", "/en/careers", "/company/careers",
]
