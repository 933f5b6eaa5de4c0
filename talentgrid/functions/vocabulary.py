"""Vocabularies and constants of the hiring domain. All are fixed values."""

# Stages in pipeline order: (key, name, kind).
DEFAULT_STAGES = (
    ("resume_submitted", "Resume submitted", "round"),
    ("hm_review", "Hiring manager review", "round"),
    ("technical_written", "Technical assessment", "round"),
    ("technical_interview", "Technical interview", "round"),
    ("problem_solving", "Problem solving", "round"),
    ("case_study", "Case study", "round"),
    ("hr_screen", "HR screen", "round"),
    ("offer", "Offer", "round"),
    ("offer_accepted", "Offer accepted", "round"),
    ("offer_declined", "Offer declined", "outcome"),
    ("hired", "Hired", "outcome"),
    ("withdrawn", "Withdrawn", "outcome"),
)
REACHED = ("in_progress", "passed", "failed")
TERMINAL = ("hired", "rejected", "declined", "withdrawn")
DECLINABLE = ("offer", "offer_accepted")
FIRST_ROUND = "resume_submitted"
MAX_CUSTOM_STAGES = 10
INTERVIEW_POSITION = 3
NO_MOVEMENT_DAYS = 7
LIST_LIMIT = 50
ACTIVITY_LIMIT = 20
LATE_STAGE_NOTE = "Added to the pipeline after this candidate had moved past this point."
MOVED_STAGE_NOTE = "Moved earlier in the pipeline after this candidate had passed this point."
STAGE_TO_CANDIDATE = {
    "resume_submitted": "active", "hm_review": "screening", "technical_written": "interviewing", "technical_interview": "interviewing",
    "problem_solving": "interviewing", "case_study": "interviewing", "hr_screen": "interviewing", "offer": "offered", "offer_accepted": "offered",
}
APPLICATION_TO_CANDIDATE = {"hired": "hired", "rejected": "rejected", "declined": "withdrawn", "withdrawn": "withdrawn"}

SOURCE_LABELS = {
    "linkedin": "LinkedIn", "referral": "Referral", "company_website": "Company website", "indeed": "Indeed", "job_board": "Other job board",
    "agency": "Agency", "direct_application": "Applied directly", "internal": "Internal", "other": "Other",
}
DEFAULT_SOURCE = "direct_application"
LEGACY_SOURCES = {"direct": "direct_application", "resume_upload": "direct_application"}
UNKNOWN_SOURCE = "Not recorded"

REGION_STATES = {
    "west coast": ("CA", "OR", "WA"),
    "east coast": ("ME", "NH", "MA", "RI", "CT", "NY", "NJ", "PA", "DE", "MD", "DC", "VA", "NC", "SC", "GA", "FL"),
    "pacific northwest": ("WA", "OR"),
    "pnw": ("WA", "OR"),
    "new england": ("ME", "NH", "VT", "MA", "RI", "CT"),
    "midwest": ("OH", "MI", "IN", "IL", "WI", "MN", "IA", "MO", "ND", "SD", "NE", "KS"),
    "south": ("TX", "OK", "AR", "LA", "MS", "AL", "TN", "KY", "GA", "FL", "SC", "NC", "VA", "WV"),
    "southwest": ("AZ", "NM", "NV", "TX", "OK"),
    "mountain west": ("CO", "UT", "ID", "MT", "WY", "NV"),
}
SOCAL = ("Los Angeles", "San Diego", "Irvine", "Long Beach", "Santa Monica", "Pasadena")
REGION_CITIES = {
    "bay area": ("San Francisco", "Oakland", "San Jose", "Berkeley", "Palo Alto", "Mountain View", "Sunnyvale"),
    "socal": SOCAL,
    "southern california": SOCAL,
    "dmv": ("Washington", "Arlington", "Alexandria", "Bethesda"),
}
ANYWHERE = (
    "anywhere", "any", "anyplace", "any location", "any city", "any state", "all", "all locations", "everywhere", "wherever", "no preference", "none", "n/a", "na", "open",
    "flexible", "world", "worldwide", "global", "country", "nationwide", "national", "us", "usa", "u.s", "u.s.a", "united states", "america", "north america",
)
PLACE_PREFIXES = ("anywhere on the ", "anywhere along the ", "anywhere in the ", "anywhere in ", "anywhere near ", "along the ", "on the ", "in the ", "the ")
MIN_SEARCH_RELEVANCE = 0.35
SEARCH_POOL = 100

STRONG, MODERATE = 0.65, 0.45
STOPWORDS = frozenset(
    "a an the and or of for to in on at with without from by as is are be who whom whose that which what any anyone anybody some someone somebody people person persons "
    "candidate candidates folks profiles profile talent find me show list give get need want looking look search seeking hire hiring have has having had worked working work "
    "works experience experienced background expertise skill skills skilled knowledge know knows knowing proficient proficiency familiar familiarity strong solid good great "
    "deep years year plus based located available open current currently recent recently former previous previously new our we you your i my their them they it its this these "
    "those there here also very really quite rather can could would should will about into over under between across around".split()
)
ROLE_WORDS = frozenset(
    "engineer engineers engineering developer developers dev devs programmer programmers coder coders manager managers management director directors head heads officer officers "
    "chief lead leads leader leaders principal staff senior sr junior jr mid midlevel entry associate associates specialist specialists analyst analysts scientist scientists "
    "architect architects designer designers consultant consultants professional professionals expert experts intern interns internship contractor contractors owner owners "
    "coordinator coordinators administrator administrators assistant assistants executive executives president vp vice role roles position positions job jobs title titles team "
    "teams software technical technology technologies tech it level levels".split()
)
ALIASES = {
    "ml": ("machine learning", "machine-learning"), "ai": ("artificial intelligence",), "genai": ("gen ai", "generative ai", "generative"), "nlp": ("natural language",),
    "llm": ("large language", "llms"), "llms": ("llm", "large language"), "k8s": ("kubernetes",), "kubernetes": ("k8s",), "js": ("javascript",), "javascript": ("js",),
    "ts": ("typescript",), "py": ("python",), "postgres": ("postgresql",), "postgresql": ("postgres",), "sre": ("site reliability",), "devops": ("dev ops",),
    "frontend": ("front-end", "front end"), "backend": ("back-end", "back end"), "fullstack": ("full-stack", "full stack"), "ux": ("user experience",), "ui": ("user interface",),
    "qa": ("quality assurance",), "pm": ("product manager", "project manager"), "grad": ("graduate",), "grads": ("graduate", "new grad"), "phd": ("ph.d", "doctorate"),
    "quant": ("quantitative",), "fintech": ("financial", "finance", "fintech"), "insurtech": ("insurance", "insurtech"), "healthtech": ("health", "healthcare", "healthtech"),
    "ecommerce": ("e-commerce", "ecommerce"), "e-commerce": ("e-commerce", "ecommerce"),
}
AMBIGUOUS = frozenset(
    "agent agents driver drivers pilot pilots real model models store stores operations operation service services support security office field market markets network networks "
    "stream streams system systems".split()
)
SHORT_TERMS = frozenset("ml ai js ts py ux ui qa pm bi hr go sql aws gcp api etl sre nlp llm cto ios".split())

LEVELS = ("entry", "junior", "mid", "senior", "lead", "principal", "executive")
LEVEL_YEARS = {"entry": 1, "junior": 2, "mid": 4, "senior": 7, "lead": 10, "principal": 12, "executive": 15}
# Words that raise the level above mid; the highest that occurs anywhere in the text holds.
LEVEL_WORDS = {
    "senior": ("senior", "sr", "sr.", "experienced", "expert", "advanced"),
    "lead": ("lead", "team lead", "technical lead", "manager", "head of", "director"),
    "principal": ("principal", "staff", "distinguished", "architect"),
    "executive": ("chief", "cto", "cio", "vp", "vice president", "executive"),
}
# Patterns of years and the group that holds the number, tried in order.
YEAR_PATTERNS = (
    (r"(\d+)\+?\s*years?\s*(of\s*)?experience", 1),
    (r"experience\s*(of|:)?\s*(\d+)\+?\s*years?", 2),
    (r"(\d+)\+?\s*yrs?\s*(of\s*)?experience", 1),
    (r"experience\s*(of|:)?\s*(\d+)\+?\s*yrs?", 2),
    (r"(\d+)\+?\s*y\.?o\.?e\.?", 1),
)
TITLE_PREFIXES = ("senior", "sr", "lead", "principal", "staff", "junior", "jr", "entry", "associate", "chief", "director", "head of", "vp", "vice president")
TITLE_SUFFIXES = ("i", "ii", "iii", "iv", "v", "1", "2", "3", "4", "5")
ROLE_CATEGORIES = {
    "data_science": ("data scientist", "data analyst", "machine learning", "ai researcher", "statistician", "analytics", "data engineer", "ml engineer"),
    "software_engineering": ("software engineer", "software developer", "backend developer", "frontend developer", "full stack", "devops", "sre", "platform engineer"),
    "product_management": ("product manager", "product owner", "business analyst"),
    "design": ("ux designer", "ui designer", "graphic designer", "design"),
    "sales_marketing": ("sales", "marketing", "account manager", "business development"),
    "finance": ("financial analyst", "accountant", "finance", "controller"),
    "operations": ("operations", "project manager", "program manager"),
    "executive": ("ceo", "cto", "cio", "vp", "director", "chief"),
}
# The role score knows one more word in two of the categories than the skill penalty.
ROLE_ONLY_WORDS = {"data_science": ("research scientist",), "software_engineering": ("systems engineer",)}
FAR_PAIRS = (
    ("data_science", "sales_marketing"), ("data_science", "design"), ("software_engineering", "sales_marketing"),
    ("software_engineering", "finance"), ("design", "finance"), ("design", "software_engineering"),
)
NEAR_PAIRS = (("data_science", "software_engineering"), ("product_management", "software_engineering"), ("data_science", "operations"), ("software_engineering", "operations"))
# (role score below, weight of skill, of role, of experience, multiplier)
TIERS = (("severe_role_mismatch", 30.0, 0.15, 0.7, 0.15, 0.25), ("moderate_role_mismatch", 50.0, 0.2, 0.6, 0.2, 0.45), ("standard", None, 0.35, 0.45, 0.2, 1.0))
NO_SIGNAL = 30.0
CAPS = ((2, 50.0), (1, 70.0))
NICE_BONUS = 10.0
YEARS_SHORT, YEARS_SHORT_MOST, YEARS_OVER, YEARS_OVER_MOST, YEARS_MISSING = 10.0, 40.0, 5.0, 20.0, 2.0
DEGREE_WORDS = (
    ("phd", ("phd", "dphil", "doctorate")),
    ("master", ("msc", "ms", "ma", "mba", "meng", "mtech", "mphil", "mres", "mfa", "mpa", "mph", "llm", "mcs", "master", "masters")),
    ("bachelor", ("bsc", "bs", "ba", "btech", "beng", "be", "bba", "bcom", "bfa", "llb", "bachelor", "bachelors")),
    ("none", ("associate", "associates", "ged", "highschool")),
)
EDUCATION_LEVELS = ("none", "bachelor", "master", "phd")
EDUCATION_LABELS = {"none": "no degree", "bachelor": "bachelor's degree", "master": "master's degree", "phd": "PhD"}
MOST_SKILLS, LONGEST_SKILL, MOST_YEARS = 20, 60, 50
NEAR_LENGTH = 3
WEAK_ROLE, WEAK_SKILL, WEAK_FACTOR = 50.0, 60.0, 0.4
LEAST_SCORE = 20.0

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
PRESENT_WORDS = ("present", "current", "now", "today")
AI_WORDS = ("ai", "a\\.i\\.", "artificial intelligence", "ml", "machine learning", "deep learning", "nlp", "llm", "genai")
MOST_POINTS = 5
OFFER_ROUNDS = ("offer", "offer_accepted")
CUSTOM_PREFIX = "custom_"
STAFF_ROLES = ("admin", "hiring_manager", "hiring_team", "interviewer")
# What each role may do.
_TEAM = ("candidates.add", "pipeline.move", "feedback.submit", "score.before_feedback", "reports.view", "profile.edit")
_MANAGER = (*_TEAM, "jobs.write", "users.invite", "templates.manage")
PERMISSIONS = {
    "admin": (*_MANAGER, "users.change_role", "records.delete", "audit.view", "candidates.export_data", "departments.manage"),
    "hiring_manager": _MANAGER, "hiring_team": _TEAM, "interviewer": ("feedback.submit", "profile.edit"), "demo": ("score.before_feedback", "reports.view"),
}
INTERVIEW_STATES = ("waiting", "upcoming", "submitted", "skipped")
_INTERVIEWS = ("technical_written", "technical_interview", "problem_solving", "case_study", "hr_screen")
STAGE_ALIASES = {
    "new": ("resume_submitted",), "applied": ("resume_submitted",), "screening": ("hm_review",), "interview": _INTERVIEWS, "interviewing": _INTERVIEWS,
    "interviews": _INTERVIEWS, "offered": OFFER_ROUNDS,
}
RECOMMENDATIONS = {"strong_hire": "Strong hire", "hire": "Hire", "no_hire": "No hire", "strong_no_hire": "Strong no hire"}
HIRE_SIDE = ("strong_hire", "hire")

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?<![\w-])(?:\+\d{1,3}[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}(?![\w-])"
LINK = r"(?i)https?://\S+|\bwww\.\S+|\b(?:linkedin|github)\.com/\S+"
EMAIL_GONE, PHONE_GONE, LINK_GONE, NAME_GONE = "[email removed]", "[phone removed]", "[link removed]", "the candidate"


# ---------------------------------------------------------------- market skills (fixed values)
#: One name for skills that have several.
SKILL_NAMES = {
    "machine learning": "ml", "deep learning": "dl", "rest apis": "rest api", "rest-api": "rest api", "rest": "rest api", "restful api": "rest api",
    "restful apis": "rest api", "ci cd": "ci/cd", "springboot": "spring boot", "js": "javascript", "node js": "node.js", "react js": "react",
    "postgresql": "sql", "postgres": "sql", "my sql": "mysql", "mysql": "sql", "artificial intelligence": "ai", "neural networks": "neural network",
    "natural language processing": "nlp", "computer vision": "cv", "scikit-learn": "scikit learn", "github": "git", "gitlab": "git", "k8s": "kubernetes",
    "amazon web services": "aws", "google cloud": "gcp", "google cloud platform": "gcp",
}
#: What separates skills within one listed phrase.
SKILL_BREAKS = r",|/|\\|\||;|\b(?:and|with|using|such as|on|including|for|to|experience with|proficient in|hands[- ]on with)\b"
#: Other words in a text that show a skill.
SKILLS_IN_TEXT = {
    "ai": r"\b(?:ai|artificial intelligence|machine learning|deep learning|neural networks?)\b",
    "ml": r"\b(?:ml|machine learning|deep learning|neural networks?)\b",
    "python": r"\b(?:python|py)\b",
    "tensorflow": r"\b(?:tensorflow|tf)\b",
    "pytorch": r"\b(?:pytorch|torch)\b",
    "pandas": r"\b(?:pandas|pd)\b",
    "numpy": r"\b(?:numpy|np)\b",
    "git": r"\b(?:git|github|gitlab)\b",
    "docker": r"\b(?:docker|container)\b",
    "kubernetes": r"\b(?:kubernetes|k8s)\b",
    "aws": r"\b(?:aws|amazon web services)\b",
    "azure": r"\b(?:azure|microsoft cloud)\b",
    "gcp": r"\b(?:gcp|google cloud|google cloud platform)\b",
}
#: Other skills that imply a skill.
SKILL_ALIASES = {
    "git": r"github|gitlab|bitbucket",
    "rest api": r"\brest\s*ful\b|\brest\b.*\bapi|\bapis\b",
    "ci/cd": r"\bci[\s\-/_]?cd\b",
    "postgres": r"postgresql|^postgres sql$",
    "sql": r"\bms\s*sql\s*server\b|\bmssql\b|\bsql\s*server\b|\bmysql\b",
    "kubernetes": r"\bk8s\b",
    "ai": r"^artificial intelligence$|machine learning|deep learning",
    "ml": r"^machine learning$|deep learning",
    "python": r"^py$|python",
    "tensorflow": r"^tf$|tensorflow",
    "pytorch": r"^torch$|pytorch",
}
CORE_AI_SKILLS = ("ai", "ml", "python", "tensorflow", "pytorch", "pandas", "numpy", "git", "aws", "azure", "gcp")
#: Skills of a role by words of its title; the last row is for all others.
ROLE_SKILLS = (
    (("gen ai", "ai engineer", "machine learning engineer"), (
        "python", "machine learning", "deep learning", "neural networks", "tensorflow", "pytorch", "scikit-learn", "pandas", "numpy", "matplotlib", "seaborn", "jupyter", "git", "github",
        "docker", "kubernetes", "aws", "azure", "gcp", "sql", "rest api", "ci/cd", "agile", "data analysis", "data cleaning", "data visualization", "nlp", "computer vision",
        "mlops", "model deployment", "api development", "cloud computing", "statistics", "linear algebra", "calculus", "probability", "optimization", "algorithms")),
    (("software engineer", "developer"), (
        "python", "java", "javascript", "typescript", "react", "angular", "vue", "node.js", "git", "github", "docker", "kubernetes", "aws", "azure", "gcp", "sql", "rest api",
        "ci/cd", "agile", "microservices", "api development", "cloud computing", "linux", "html", "css", "bootstrap", "tailwind", "express", "spring", "django", "flask",
        "postgresql", "mysql", "mongodb", "redis", "elasticsearch", "kafka", "rabbitmq")),
    (("data scientist", "data analyst"), (
        "python", "r", "sql", "pandas", "numpy", "matplotlib", "seaborn", "jupyter", "scikit-learn", "tensorflow", "pytorch", "statistics", "machine learning",
        "data analysis", "data cleaning", "data visualization", "git", "github", "aws", "azure", "gcp", "tableau", "power bi", "excel", "spark", "hadoop",
        "probability", "linear algebra", "calculus", "optimization", "ab testing")),
    ((), (
        "python", "java", "javascript", "git", "sql", "aws", "azure", "gcp", "docker", "kubernetes", "rest api", "ci/cd", "agile", "cloud computing", "linux",
        "html", "css", "react", "node.js", "postgresql", "mysql", "mongodb")),
)
