"""Word lists, limits and weights that the results depend on."""

# --- Fixed values: they must equal those that the results are compared with. ---

TITLE_ALIASES = {"sr": "senior", "jr": "junior", "tpm": "technical program manager", "pm": "product manager"}
COUNTRY_SUFFIXES = (", united states", ", usa", ", us", ", uk", ", ca")

CURRENCY_TO_USD = {"$": 1.0, "USD": 1.0, "£": 1.27, "GBP": 1.27, "€": 1.08, "EUR": 1.08, "C$": 0.73, "CAD": 0.73, "A$": 0.66, "AUD": 0.66}

WORK_MODES = ("remote", "hybrid", "onsite")
WORK_MODE_TOKENS = {
    "remote": ("remote", "anywhere", "distributed", "worldwide", "work from home", "wfh"),
    "hybrid": ("hybrid", "flex arrangement", "flexible schedule", "partially remote"),
    "onsite": ("onsite", "on-site", "on site", "in office", "in-office", "in person", "in-person"),
}
COUNTRY_ONLY = (
    "united states", "usa", "u.s.", "u.s.a.", "us", "canada", "united kingdom", "uk", "u.k.", "great britain", "england",
    "ireland", "germany", "france", "spain", "italy", "netherlands", "australia", "new zealand", "india", "japan",
    "singapore", "brazil", "mexico", "remote (us)", "remote us", "remote, us", "remote, usa", "remote (eu)", "remote eu",
    "remote, eu", "remote (uk)", "remote uk", "remote, uk", "north america", "europe", "emea", "apac", "americas", "latam",
)
US_STATE_CODES = (
    "al", "ak", "az", "ar", "ca", "co", "ct", "de", "fl", "ga", "hi", "id", "il", "in", "ia", "ks", "ky", "la", "me", "md",
    "ma", "mi", "mn", "ms", "mo", "mt", "ne", "nv", "nh", "nj", "nm", "ny", "nc", "nd", "oh", "ok", "or", "pa", "ri", "sc",
    "sd", "tn", "tx", "ut", "vt", "va", "wa", "wv", "wi", "wy", "dc",
)
#: Tokens of a country in the order in which they are tried.
COUNTRY_TOKENS = {
    "US": (
        "united states", "u.s.a", " usa", "usa,", "u.s.", " us,", ", us", "/us", "-us", "remote - us", "remote, us", "remote (us",
        "us only", "us-only", "us remote",
        "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida", "georgia",
        "hawaii", "idaho", "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana", "maine", "maryland", "massachusetts",
        "michigan", "minnesota", "mississippi", "missouri", "montana", "nebraska", "nevada", "new hampshire", "new jersey",
        "new mexico", "new york", "north carolina", "north dakota", "ohio", "oklahoma", "oregon", "pennsylvania", "rhode island",
        "south carolina", "south dakota", "tennessee", "texas", "utah", "vermont", "virginia", "washington state", "west virginia",
        "wisconsin", "wyoming",
        "san francisco", "los angeles", "seattle", "boston", "chicago", "austin", "denver", "atlanta", "portland", "san jose",
        "palo alto", "mountain view", "menlo park", "sunnyvale", "irvine", "san diego", "washington dc", "washington, d.c", "miami",
        "brooklyn", "manhattan", "bellevue", "redmond", "cambridge ma", "cupertino", "santa clara", "livingston, nj", "houston",
        "phoenix", "philadelphia", "dallas", "fort worth", "jacksonville", "charlotte", "indianapolis", "columbus", "detroit",
        "nashville", "memphis", "baltimore", "milwaukee", "oakland", "tulsa", "minneapolis", "cleveland", "tampa", "orlando",
        "sacramento", "honolulu", "pittsburgh", "cincinnati", "raleigh", "st. louis", "saint louis", "new orleans", "kansas city",
        "las vegas", "salt lake", "albuquerque", "omaha", "newark", "arlington", "st. paul", "saint paul", "hoboken", "jersey city",
        "stamford", "hartford", "providence", "richmond", "durham", "charleston", "columbus oh", "buffalo", "rochester", "syracuse",
        "albany",
    ),
    "GB": (
        "united kingdom", " uk,", ", uk", "/uk", "-uk", "great britain", "england", "scotland", "wales", "london", "manchester",
        "edinburgh", "birmingham", "leeds", "bristol", "cambridge uk", "oxford",
    ),
    "IE": ("ireland", "dublin", " cork", "galway", "limerick"),
    "CA": ("canada", "toronto", "vancouver", "montreal", "ottawa", "calgary", "edmonton", "waterloo"),
    "IN": ("india", "bangalore", "bengaluru", "mumbai", "delhi", "hyderabad", "chennai", "pune", "noida", "gurgaon", "gurugram", "kolkata"),
    "MX": ("mexico", "ciudad de m", "guadalajara", "monterrey", "cdmx"),
    "BR": ("brazil", "brasil", "são paulo", "sao paulo", "rio de janeiro"),
    "DE": ("germany", "berlin", "munich", "hamburg", "frankfurt"),
    "FR": ("france", "paris", "lyon", "toulouse"),
    "NL": ("netherlands", "amsterdam", "rotterdam", "the hague"),
    "PL": ("poland", "warsaw", "krakow", "kraków", "gdansk"),
    "AU": ("australia", "sydney", "melbourne", "brisbane", "perth"),
    "NZ": ("new zealand", "auckland", "wellington"),
    "JP": ("japan", "tokyo", "osaka", "kyoto"),
    "SG": ("singapore",),
    "PH": ("philippines", "manila", "cebu"),
    "ID": ("indonesia", "jakarta"),
    "AR": ("argentina", "buenos aires"),
    "CL": ("chile", "santiago"),
    "CO": ("colombia", "bogot"),
    "ES": ("spain", "madrid", "barcelona"),
    "PT": ("portugal", "lisbon", "porto"),
    "IT": ("italy", "milan", "rome"),
    "IL": ("israel", "tel aviv", "jerusalem"),
    "AE": ("united arab emirates", "dubai", "abu dhabi"),
    "ZA": ("south africa", "cape town", "johannesburg"),
    "KR": ("south korea", "seoul"),
    "CN": ("china", "shanghai", "beijing", "shenzhen"),
    "HK": ("hong kong",),
    "TW": ("taiwan", "taipei"),
    "VN": ("vietnam", "ho chi minh"),
    "TH": ("thailand", "bangkok"),
    "EG": ("egypt", "cairo"),
    "NG": ("nigeria", "lagos"),
    "KE": ("kenya", "nairobi"),
    "CH": ("switzerland", "zurich", "geneva"),
    "SE": ("sweden", "stockholm"),
    "DK": ("denmark", "copenhagen"),
    "NO": ("norway", "oslo"),
    "FI": ("finland", "helsinki"),
    "BE": ("belgium", "brussels"),
    "AT": ("austria", "vienna"),
    "CZ": ("czech", "prague"),
    "RO": ("romania", "bucharest"),
    "GR": ("greece", "athens"),
    "TR": ("turkey", "istanbul", "ankara"),
    "RU": ("russia", "moscow"),
    "UA": ("ukraine", "kyiv", "kiev"),
}
COUNTRY_ALIASES = {
    "us": "US", "usa": "US", "u.s.": "US", "u.s.a": "US", "united states": "US", "america": "US", "uk": "GB", "u.k.": "GB",
    "united kingdom": "GB", "great britain": "GB", "britain": "GB", "england": "GB", "scotland": "GB", "wales": "GB", "gb": "GB",
    "ireland": "IE", "eire": "IE", "ie": "IE", "canada": "CA", "ca": "CA", "germany": "DE", "de": "DE", "france": "FR", "fr": "FR",
    "netherlands": "NL", "holland": "NL", "nl": "NL", "australia": "AU", "au": "AU", "india": "IN", "in": "IN", "spain": "ES",
    "es": "ES", "italy": "IT", "it": "IT", "japan": "JP", "jp": "JP", "singapore": "SG", "sg": "SG",
}

LEVEL_RANK = {"junior": 1, "mid": 2, "senior": 3, "staff": 4, "principal": 5, "director": 6, "vp": 7, "cxo": 8}
LEVEL_ALIASES = {
    "new grad": "junior", "new-grad": "junior", "apm": "junior", "associate": "junior", "graduate": "junior", "intern": "junior",
    "entry": "junior", "entry-level": "junior", "junior": "junior", "mid": "mid", "mid-level": "mid", "pm": "mid",
    "product manager": "mid", "senior": "senior", "sr": "senior", "lead": "senior", "staff": "staff", "principal": "staff",
    "staff/principal": "staff", "director": "director", "head of": "director", "head-of": "director", "vp": "vp",
    "vice president": "vp", "cxo": "cxo", "cpo": "cxo", "chief product officer": "cxo",
}
LEVEL_YEARS = {"junior": 0, "mid": 2, "senior": 5, "staff": 8, "principal": 10, "director": 12, "vp": 15, "cxo": 18}
TITLE_LEVELS = (
    ("group product manager", "director"), ("group pm", "director"), ("group product", "director"), ("staff ", "staff"),
    ("staff,", "staff"), (", staff", "staff"), ("principal", "staff"), ("director of", "director"), (" director", "director"),
    ("head of", "director"), ("vp ", "vp"), ("vp,", "vp"), ("senior ", "senior"), ("lead ", "senior"), ("sr. ", "senior"),
    ("sr ", "senior"), ("junior", "junior"), ("associate", "junior"), ("graduate", "junior"),
)
TRAPDOOR_LEVELS = ("director", "vp", "cxo")
TRAPDOOR_YEARS = 10
TRAPDOOR_TITLES = (
    "director of", " director,", ", director ", "head of ", "vp ", "vp,", "vp of ", "vice president", "chief ", "cto", "cpo", "ceo",
    "coo", "cfo",
)
NON_PM_PRODUCT_TITLES = (
    "product marketing", "product designer", "product design ", "product engineer", "product analyst", "product researcher",
    "product research ", "product specialist", "product sales", "product support", "product associate", "product counsel",
    "product writer", "product copywriter", "product editor",
)

SCAM_PHRASES = (
    "wire transfer", "western union", "money order", "pay upfront", "processing fee", "background check fee", "training fee",
    "send money", "wire funds", "personal bank", "guaranteed income", "unlimited earning", "get rich", "no experience necessary",
    "no skills required", "work from home $", "earn $ per", "make money fast",
)
GHOST_PHRASES = (
    "always hiring", "continuous posting", "evergreen", "talent pool", "future opportunities", "pipeline role",
    "general application", "talent community",
)
HIDDEN_COMPANIES = ("n/a", "none", "unknown", "confidential", "")
SHORTENERS = ("bit.ly", "tinyurl", "t.co", "goo.gl")

CALIBRATION = (
    (0.00, 0.00), (0.30, 0.04), (0.38, 0.09), (0.42, 0.12), (0.45, 0.20), (0.48, 0.30), (0.50, 0.40), (0.52, 0.52), (0.55, 0.68),
    (0.58, 0.80), (0.62, 0.86), (0.68, 0.91), (0.75, 0.94), (1.00, 0.95),
)

GHOST_SEVERE_LOCATIONS = ("", "remote", "worldwide", "anywhere", "global", "remote - global", "remote (global)")
GHOST_LIGHT_LOCATIONS = ("united states", "usa", "us", "uk", "united kingdom", "europe", "emea", "apac", "americas")
GHOST_LEVEL_YEARS = {
    "junior": (0, 3), "mid": (2, 6), "senior": (4, 12), "staff": (7, 20), "principal": (10, 25), "director": (8, 30), "vp": (10, 30),
    "cxo": (12, 40),
}
GHOST_TITLE_LEVELS = (
    ("staff ", "staff"), ("principal ", "principal"), ("director of ", "director"), (" director", "director"),
    ("head of ", "director"), ("vp ", "vp"), ("vp,", "vp"), ("senior ", "senior"), ("lead ", "senior"), ("sr. ", "senior"),
    ("sr ", "senior"), ("junior", "junior"), ("associate ", "junior"), ("graduate", "junior"),
)
BUZZWORDS = (
    "rockstar", "ninja", "guru", "wizard", "superstar", "wear many hats", "wear multiple hats", "fast-paced", "fast paced",
    "hit the ground running", "self-starter", "go-getter", "passionate", "driven", "dynamic environment", "thrive in chaos",
    "work hard play hard", "think outside the box", "we're a family", "we are a family", "unicorn", "disruptive", "synergy",
    "competitive salary", "salary commensurate",
)
STACK_CATEGORIES = {
    "backend_langs": ("python", "java", "go", "golang", "rust", "ruby", "php", "c#", ".net", "kotlin", "scala", "elixir", "c++"),
    "frontend_langs": ("javascript", "typescript", "react", "vue", "angular", "svelte"),
    "clouds": ("aws", "gcp", "google cloud", "azure", "digitalocean", "heroku"),
    "data_stores": ("postgres", "postgresql", "mysql", "mongodb", "cassandra", "redis", "dynamodb", "bigquery", "snowflake", "elasticsearch"),
    "infra": ("kubernetes", "docker", "terraform", "ansible", "pulumi", "helm"),
    "ml": ("pytorch", "tensorflow", "jax", "scikit-learn", "hugging face"),
}
#: Signal: weight in the average, and how high it can lift the score alone.
GHOST_SIGNALS = {
    "age_stale": (0.20, 0.70), "salary_band_wide": (0.06, 0.40), "location_vague": (0.06, 0.40), "seniority_conflict": (0.14, 0.50),
    "buzzword_density": (0.06, 0.28), "missing_fields": (0.20, 0.55), "duplicate_title": (0.14, 0.65),
    "apply_url_missing": (0.06, 0.50), "overloaded_stack": (0.08, 0.40),
}
GHOST_PRESETS = {"low": 0.60, "balanced": 0.45, "strict": 0.30}

TITLE_STOP_WORDS = ("a", "an", "the", "of", "for", "in", "on", "at", "to", "with", "and", "or")
TRACKING_PARAMS = ("utm_", "gh_", "mc_", "fbclid", "gclid", "ref", "source", "s_")
ARCHETYPES = (
    ("director|vp|vice president|head of|chief|cxo|cto|cpo", "director"),
    ("technical program manager|program manager|tpm", "tpm"),
    ("ai|ml|llm|gen-?ai|machine learning|model|agent|inference|rag|foundation|prompt", "ai_pm"),
    ("platform|infra|infrastructure|developer platform|internal tools|api|sdk|devtools|dev tools", "platform_pm"),
    ("growth|funnel|activation|monetization|retention|acquisition", "growth_pm"),
    ("product operations|product ops|productops|pmo", "ops_pm"),
    ("product manager|product management", "pm"),
    ("designer|engineer|researcher|marketing manager|brand manager|content manager", "other"),
)
APPLICATION_WEIGHTS = {"applied": 1.0, "responded": 2.0, "interview": 3.0, "offer": 5.0, "rejected": -2.0, "passed": -0.5}
STALE_DAYS, STALE_WEIGHT = 7, -0.125

PROFILE_RANK = {"intern": 0, "entry": 1, "junior": 1, "mid": 2, "senior": 3, "staff": 4, "principal": 5, "director": 6, "vp": 7, "cxo": 8}
PROFILE_YEARS = {"intern": 0, "entry": 0, "junior": 0, "mid": 2, "senior": 5, "staff": 8, "principal": 10, "director": 10, "vp": 12, "cxo": 15}
LANE_BOILERPLATE = (
    r"\b(?:senior|staff|principal|lead|sr\.?|group|director|head|vp|vice president|product manager|program manager"
    r"|technical program manager|tpm|forward deployed|enterprise|global|remote|intern|internship|junior|associate|graduate"
    r"|new grad|entry[\s-]?level)\b"
)
GENERIC_LANE_WORDS = ("product", "manager", "management", "program", "technical", "the", "and", "for", "with", "team", "systems", "system", "services", "service")

YEARS_EXPERIENCE = (
    r"(?i)(?<![\w.])(\d{1,2})\s*\+?\s*(?:to\s*\d{1,2}\s*)?(?:years?|yrs?|yoe)\s*(?:of\s+)?(?:[a-z][a-z /&+,.\-]{0,40}?\s*)?"
    r"(?:experience|exp\b|\bin\s+(?:product|pm|program|engineering|design|marketing|sales|ops|operations|data|software|eng\b|ml|ai"
    r"|platform|security|research|strategy|finance|leadership|management)|leading|managing|building)"
)
YEARS_PLAIN = r"(?i)(?<![\w.])(\d{1,2})\s*(?:\+|\s*-\s*\d{1,2})?\s*\+?\s*(?:years?|yrs?)\b"
GHOST_YEARS = r"(?i)(\d{1,2})\s*(?:\+|(?:to|-|–|—)\s*(\d{1,2}))?\s*(?:years?|yrs?)\b"

COMPANY_TIERS = {
    "mega": (
        "amazon", "aws", "google", "alphabet", "youtube", "nvidia", "adobe", "salesforce", "ibm", "cisco", "intel", "apple",
        "microsoft", "meta", "facebook", "oracle", "tesla", "sap", "linkedin", "uber", "netflix",
    ),
    "large": (
        "stripe", "databricks", "openai", "anthropic", "scale ai", "scaleai", "coinbase", "airbnb", "doordash", "pinterest", "spotify",
        "cloudflare", "lyft", "snowflake", "datadog", "roblox", "reddit", "robinhood", "mongodb", "twilio", "gitlab", "dropbox",
        "okta", "affirm", "plaid", "discord", "instacart", "samsara", "elastic", "sofi", "block", "square", "shopify", "zoom",
        "atlassian", "twitch", "duolingo", "github", "asana", "figma", "notion", "canva", "rippling", "gusto",
    ),
}
FRESHNESS_DAYS = {"mega": 30, "large": 14, "growth": 7}
NEW_HOURS, DORMANT_HOURS, LAPSED_HOURS = 48, 48, 14 * 24
TRIAGE_STOP_WORDS = (
    "product", "manager", "senior", "lead", "principal", "staff", "director", "head", "of", "the", "a", "an", "and", "or", "&", "for",
    "to", "at", "in", "on", "with", "new", "role", "ii", "iii", "-", ",", "team", "group", "engineer", "engineering", "program",
    "technical",
)
NON_SKILL_WORDS = (
    "the", "and", "with", "for", "from", "that", "this", "have", "will", "team", "work", "role", "product", "engineer", "manager",
    "senior",
)

SALARY_BY_SIGN = r"([$£€])\s*(\d{2,3}[,.]?\d{0,3})\s*([kK])?\s*(?:[-–—]|to)\s*[$£€]?\s*(\d{2,3}[,.]?\d{0,3})\s*([kK])?"
SALARY_BY_CODE = r"(?i)\b(USD|GBP|EUR)\s*\$?\s*(\d{2,3}[,.]?\d{0,3})\s*(k)?\s*(?:[-–—]|to)\s*\$?\s*(\d{2,3}[,.]?\d{0,3})\s*(k)?"
SALARY_FLOOR = r"(?i)(?:starting\s+at|from)\s*([$£€])\s*(\d{2,3}[,.]?\d{0,3})\s*(k)?"
HOURLY = r"(?i)/\s*(?:hour|hr)\b|per\s+hour"
HOURLY_NEAR = 30
SALARY_RANGE = (20_000, 2_000_000)
SALARY_IN_THOUSANDS = (50, 999)
SALARY_SPREAD = 6

KEEP_HEADINGS = (
    "what you'll do", "what you will do", "responsibilities", "the role", "your role", "what you'll bring", "what you will bring",
    "requirements", "qualifications", "minimum qualifications", "basic qualifications", "what we're looking for", "you have",
    "you will", "in this role",
)
BOILERPLATE_HEADINGS = (
    "about us", "about the company", "our mission", "our values", "equal opportunity", "benefits", "perks", "why join",
    "total rewards", "eeo",
)
SECTION_HEADINGS = (
    "what you'll do", "what you will do", "what you’ll do", "responsibilities", "the role", "your role", "the job",
    "your day to day", "day-to-day", "in this role", "you will", "your impact", "what you'll bring", "what you will bring",
    "what you’ll bring", "requirements", "qualifications", "minimum qualifications", "basic qualifications",
    "required qualifications", "preferred qualifications", "nice to have", "nice-to-have", "nice to haves", "nice-to-haves",
    "what we're looking for", "what we are looking for", "what we’re looking for", "who you are", "about you", "you have",
    "skills and qualifications", "skills & qualifications", "experience",
)

DEFAULT_TARGETS = {
    "junior": ("Associate Product Manager", "Product Manager"),
    "mid": ("Product Manager", "Senior Product Manager"),
    "senior": ("Senior Product Manager", "Lead Product Manager", "Staff Product Manager"),
    "staff": ("Staff Product Manager", "Principal Product Manager", "Group Product Manager"),
    "principal": ("Principal Product Manager", "Group Product Manager", "Director of Product"),
    "director": ("Director of Product", "Senior Director, Product", "VP Product"),
    "vp": ("VP Product", "Senior Director, Product", "Chief Product Officer"),
    "cxo": ("Chief Product Officer", "VP Product"),
}
HIGH_TITLES = ("head of", "director", "vp", "vice president", "chief", "c-level", "cxo", "cto", "cpo", "ceo", "founder")
OFF_DOMAIN_TITLES = ("engineer", "architect", "developer", "scientist", "designer", "marketer", "analyst", "consultant")
PROMPT_PHRASES = ("ignore previous instructions", "ignore all previous instructions", "system:", "assistant:", "user:", "<|im_start|>", "<|im_end|>")
PROFILE_STACK = (
    r"react(?:\.?js)?", "python", "javascript", "typescript", "java", "go(?:lang)?", "rust", "ruby", r"node(?:\.?js)?", "sql", "postgres",
    "mysql", "mongo(?:db)?", "kubernetes", "docker", "aws", "gcp", "azure", "tableau", "looker", "ml", "llm", "storybook", "wcag",
    "figma", "jira", "confluence",
)
PROFILE_DOMAINS = {
    "fintech": ("payments", "banking", "trading", "wealth"), "devtools": ("developer tools", "platform", "devtools", "ci/cd"),
    "healthcare": ("healthcare", "clinical", "patient", "ehr"), "commerce": ("ecommerce", "marketplace", "checkout", "storefront"),
    "ai/ml": ("machine learning", "ai", "llm", "neural"), "security": ("security", "infosec", "compliance", "soc 2"),
}
PROFILE_LEVELS = (
    ("staff", "staff"), ("principal", "principal"), ("director of", "director"), ("head of", "director"), ("senior ", "senior"),
    ("lead ", "senior"), ("junior", "junior"), ("associate", "junior"),
)
GUESSED_SENIORITY = (
    ("senior", "senior"), ("sr.", "senior"), ("sr ", "senior"), ("staff", "senior"), ("principal", "senior"), ("lead", "lead"),
    ("head of", "lead"), ("director", "director"), ("vp", "director"), ("vice president", "director"), ("junior", "junior"),
    ("jr", "junior"), ("associate", "junior"), ("entry", "junior"),
)

REMOTE_SIGNS = ("remote", "anywhere", "worldwide", "distributed", "global", "wfh", "work from home", "work-from-home")
#: Words that tie a remote posting to a region.
FOREIGN_REGIONS = (
    r"uk|u\.k\.|united kingdom|great britain|britain|england|scotland|wales|northern ireland",
    r"eu|e\.u\.|emea|europe|european|eea|eurozone",
    r"germany|france|spain|italy|netherlands|holland|belgium|sweden|norway|denmark|finland|poland|ireland|portugal|switzerland|austria",
    r"canada|canadian|mexico|mexican",
    r"latam|latin america|brazil|brasil|argentina|chile|colombia|peru|uruguay",
    r"apac|asia|asian|india|singapore|japan|korea|china|taiwan|thailand|vietnam|philippines|malaysia|indonesia|hong kong",
    r"anz|australia|australian|new zealand|nz",
    r"uae|dubai|saudi|israel|south africa|africa|mena",
)
US_REGION = r"us|u\.s\.|usa|u\.s\.a\.|united states|america|american|stateside"
VAGUE_TITLES = r"^(?:job|position|role|opening|opportunity)$|^various\s|^multiple\s|\bvarious\b"
DATE_FIELDS = ("posted_at", "posted_date", "published_at", "publishedAt", "updated_at", "updatedAt", "created_at", "createdAt", "date")
SENIOR_QUERIES = ("director of", "head of ", "vp ", "vp of", "vice president", "chief ", "group product manager")
YEARS_FIELDS = (
    "description", "title", "requirements", "qualifications", "basic_qualifications", "preferred_qualifications", "responsibilities", "summary",
    "technologies", "team",
)
FREE_MAIL = ("gmail", "yahoo", "hotmail", "outlook")
