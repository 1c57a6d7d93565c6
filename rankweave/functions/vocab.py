"""Fixed values of the engine: small tables, thresholds and patterns."""

from __future__ import annotations

# --- Fixed values: proficiency labels and their weights ---
PROFICIENCY = {
    "novice": 0.3, "beginner": 0.5, "basic": 0.5, "advanced beginner": 0.7, "intermediate": 1.0,
    "competent": 1.2, "proficient": 1.5, "advanced": 1.7, "expert": 2.0, "certified": 2.0,
}
DEFAULT_PROFICIENCY = 1.0
LEVELS = [(2.0, "Expert"), (1.7, "Advanced"), (1.5, "Proficient"), (1.2, "Competent"), (1.0, "Intermediate"), (0.7, "Advanced Beginner"), (0.5, "Beginner")]
LOWEST_LEVEL = "Novice"

# --- Fixed values: abbreviations ---
ABBREVIATIONS = {
    "ml": "machine learning", "ai": "artificial intelligence", "dl": "deep learning", "nlp": "natural language processing",
    "rl": "reinforcement learning", "genai": "generative ai", "llm": "large language model",
    "js": "javascript", "ts": "typescript", "py": "python", "rb": "ruby", "cpp": "c++", "c#": "csharp", "vb": "visual basic",
    "rn": "react native", "ng": "angular", "vue": "vuejs", "express": "expressjs", "dj": "django", "fl": "flask",
    "aws": "amazon web services", "gcp": "google cloud platform", "k8s": "kubernetes", "tf": "terraform",
    "ci/cd": "continuous integration continuous deployment", "cicd": "continuous integration continuous deployment",
    "sql": "sql", "nosql": "nosql", "etl": "extract transform load", "bi": "business intelligence", "dw": "data warehouse", "ds": "data science",
    "vapt": "vulnerability assessment penetration testing", "soc": "security operations center", "iam": "identity access management",
    "pm": "project management", "ba": "business analysis", "qa": "quality assurance", "ui": "user interface", "ux": "user experience",
    "erp": "enterprise resource planning", "crm": "customer relationship management", "hr": "human resources", "sap": "sap",
    "rpa": "robotic process automation",
    "pmp": "project management professional", "csm": "certified scrum master", "fda": "food and drug administration",
    "gdpr": "general data protection regulation", "hipaa": "health insurance portability accountability act",
}

# --- Fixed values: names of one skill ---
ALIASES = {
    "react.js": "react", "reactjs": "react", "react js": "react", "node.js": "nodejs", "node js": "nodejs",
    "vue.js": "vuejs", "vue js": "vuejs", "express.js": "expressjs", "express js": "expressjs",
    "next.js": "nextjs", "next js": "nextjs", "angular.js": "angularjs", "angular js": "angularjs",
    "scikit-learn": "scikit learn", "sci-kit learn": "scikit learn", "power bi": "powerbi", "power-bi": "powerbi",
    "machine-learning": "machine learning", "deep-learning": "deep learning", "data-science": "data science",
    "data science": "data science", "devops": "devops", "dev ops": "devops", "dev-ops": "devops",
    "front end": "frontend", "front-end": "frontend", "back end": "backend", "back-end": "backend",
    "full stack": "fullstack", "full-stack": "fullstack", "micro services": "microservices",
    "micro-services": "microservices", "postgres": "postgresql", "mongo db": "mongodb", "mongo": "mongodb",
}

# --- Fixed values: endings of a skill name, the first that fits is cut once ---
SUFFIXES = [
    " programming", " language", " development", " framework", " library", " platform", " tool", " tools",
    " technologies", " technology", " skills", " skill", " certification", " certified", " developer", " engineer", " engineering",
]

# --- Fixed values: groups of synonyms, the canonical term first ---
SYNONYMS = [
    ["machine learning", "ml", "statistical learning"], ["artificial intelligence", "ai"], ["deep learning", "dl", "neural networks"],
    ["natural language processing", "nlp", "text mining", "text analytics"],
    ["computer vision", "cv", "image recognition", "image processing"], ["data science", "data analytics", "data analysis"],
    ["cloud computing", "cloud", "amazon web services", "azure", "google cloud platform"],
    ["devops", "site reliability engineering", "sre", "infrastructure"], ["kubernetes", "k8s", "container orchestration"],
    ["docker", "containerization", "containers"], ["react", "reactjs"], ["python", "py"], ["javascript", "js"], ["typescript", "ts"],
    ["sql", "structured query language"], ["nosql", "non relational database"], ["agile", "scrum", "kanban"],
    ["project management", "pm", "project management professional"],
    ["cybersecurity", "information security", "infosec", "cyber security"],
    ["vulnerability assessment penetration testing", "vapt", "penetration testing", "pen testing"],
    ["robotic process automation", "rpa"], ["enterprise resource planning", "erp", "sap"],
    ["business intelligence", "bi", "reporting", "dashboards"],
    ["extract transform load", "etl", "data pipeline", "data engineering"],
    ["frontend", "front end development", "ui development"], ["backend", "back end development", "server side"],
    ["fullstack", "full stack development"], ["microservices", "micro services architecture"],
    ["rest api", "restful api", "api development"], ["postgresql", "postgres"], ["mongodb", "mongo"],
]

# --- Fixed values: replacements of typographic characters ---
TYPOGRAPHY = {
    "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "...",
    "â\u0080\u0099": "'", "â\u0080\u0093": "-", "â\u0080\u009c": '"', "â\u0080\u009d": '"',
}

# --- Fixed values: scoring ---
K1, B, DELTA = 1.5, 0.75, 0.5
RRF_K, ALPHA_BM25, ALPHA_DENSE = 60, 0.40, 0.60
CORE_TF, SECONDARY_TF, CORE_IDF, CORE_WEIGHT = 3.0, 1.2, 1.5, 1.2
STRATEGY_WEIGHTS, OTHER_STRATEGY = {"original": 1.0, "synonym": 1.0, "related_tech": 1.2}, 0.6
BM25_FLOOR, DENSE_GATE, DENSE_GATE_EMPTY, SCORE_FLOOR, CORE_HIT = 0.15, 0.75, 0.60, 0.35, 0.3
YEARS_SLACK = 2.5
BAND_MINIMA = {"junior": 0, "mid": 2, "senior": 5, "lead": 8, "principal": 10}
GRAPH_DIRECT, GRAPH_RELATED, GRAPH_ROLE, GRAPH_DOMAIN, GRAPH_DECAY = 3.0, 1.5, 2.0, 1.0, 0.5
YEARS_EXACT, YEARS_CLOSE, SENIORITY_BONUS = 2.0, 1.0, 0.5
INTENT_ALPHA = {
    "single_skill": 0.35, "domain_search": 0.30, "multi_skill": 0.40, "role_based": 0.55,
    "experience_filter": 0.60, "location_based": 0.65, "hybrid": 0.50,
}
OTHER_ALPHA = 0.50
MODIFIERS = {"experience_filter": 0.05, "location_filter": 0.03, "seniority_match": 0.03}
NEGATION_PENALTY = -0.10
SENIORITY = {
    "senior": ["senior", "lead", "principal", "staff", "architect"],
    "mid": ["mid", "intermediate", "engineer", "developer"],
    "junior": ["junior", "associate", "intern", "entry"],
    "manager": ["manager", "head", "director", "vp"],
}

# --- Fixed values: words that are no graph terms ---
GRAPH_STOP = [
    "someone", "with", "and", "or", "a", "an", "the", "in", "of", "for", "to", "candidate", "skilled", "proficient",
    "experience", "years", "role", "engineer", "developer", "full", "stack", "senior", "junior", "mid", "lead", "manager",
]

# --- Fixed values: negation triggers and how many words they cover ---
NEGATIONS = [
    (r"\bnot\b", 2), (r"\bno\b", 2), (r"\bwithout\b", 2), (r"\bexcluding?\b", 2),
    (r"\bavoid\b", 2), (r"\bnon[-\s]", 1), (r"\bexcept\b", 3), (r"\bprefer\s+not\b", 2),
]

# --- Fixed values: experience bands, the first that fits counts ---
BANDS = {
    "entry": [r"\b(0[-–]?[12])\s*years?\b", r"\b(fresher|fresh\s+graduate|entry[\s-]level|junior|intern|trainee|graduate)\b", r"\b0[-–]2\s*years?\b"],
    "mid": [r"\b([23][-–]?[45])\s*years?\b", r"\b(mid[\s-]level|intermediate|associate|3[-–]5\s*years?)\b"],
    "senior": [r"\b([5-9]|10)\s*\+?\s*years?\b", r"\b(senior|sr\.?|lead|principal|staff|expert|specialist)\b"],
    "executive": [r"\b(1[0-9]|20)\s*\+?\s*years?\b", r"\b(director|vp|vice\s+president|head\s+of|c-?level|cto|cpo|cio)\b"],
}
YEARS = r"(\d+)\s*\+?\s*years?"
PLACES = ["noida", "bangalore", "bengaluru", "pune", "gurgaon", "gurugram", "hyderabad", "chennai", "mumbai", "delhi", "haryana", "karnataka", "maharashtra", "india"]
WORK_MODES = ["remote", "hybrid", "onsite", "on-site", "office", "wfh", "work from home"]

# --- Fixed values: rules by intent, in order ---
RULES = [
    ("multi_skill", [r"\b(react|python|node|java|aws|sql|ml|golang|typescript|docker|kubernetes|django|fastapi)\b.{0,20}\b(and|&|\+|plus|with|along)\b.{0,20}\b(react|python|node|java|aws|sql|ml|golang|typescript|docker|kubernetes|django|fastapi)\b", r"\bfull[\s-]?stack\b", r"\bpolyglot\b"]),
    ("comparative", [r"\bvs\.?\b", r"\bversus\b", r"\bcompare\b", r"\bdifference\s+between\b", r"\bbetter\b.{0,10}\bor\b"]),
    ("ranking", [r"\b(best|top|strongest|most\s+qualified|highest\s+rated)\b", r"\brank(ed|ing)?\b"]),
    ("availability", [r"\b(available|availability|open\s+to\s+work|actively\s+looking)\b", r"\bimmediately\s+available\b"]),
    ("domain_search", [r"\b(fintech|healthtech|edtech|ecommerce|saas|gaming|blockchain|cybersecurity)\b", r"\b(finance|healthcare|education|retail)\s+(background|domain|experience|industry)\b"]),
    ("experience_filter", [r"\b\d+\s*\+?\s*years?\b", r"\b(senior|sr\.?|lead|principal|staff|mid[\s-]level|entry[\s-]level|fresher|junior)\b"]),
    ("skill_search", [r"\bwho\s+(knows?|uses?|works?\s+with|is\s+skilled\s+in)\b", r"\b(proficient|experienced?|skilled?)\s+in\b"]),
    ("role_search", [r"\b(find|get|show|looking\s+for|need|hire|hiring)\b.{0,30}(engineer|developer|analyst|manager|scientist)", r"\bwho\s+(is|are|works?\s+as)\b"]),
]

# --- Fixed values: query templates by intent ---
TEMPLATES = {
    "role_search": ["{role} candidate profile", "experienced {role} engineer developer", "{role} skills background experience"],
    "skill_search": ["candidate with {skills} skills", "proficient in {skills} experience", "{skills} developer engineer hands-on"],
    "experience_filter": ["{experience_years} years experience {skills}", "{experience_band} {role} engineer developer", "{experience_band} level {skills} engineer"],
    "multi_skill": ["full stack {skills} developer engineer", "candidate proficient in {skills}", "{skills} polyglot combined technology stack"],
    "ranking": ["top {role} candidates qualified", "best {skills} developers engineers ranked"],
    "availability": ["available {role} developer engineer", "open to work {skills} {location}", "{skills} developer immediately available"],
    "domain_search": ["{domain} industry {role} developer", "{role} with {domain} background experience", "candidate {domain} sector domain expertise"],
    "comparative": ["{skills} comparison candidate profiles", "candidates different {skills} technology stacks"],
    "unknown": ["{query}", "{skills} {role} profile candidate"],
}

# --- Fixed values: related skills without a graph ---
RELATIONS = {
    "python": ["machine learning", "data science", "django", "fastapi", "pandas", "pyspark"],
    "javascript": ["react", "nodejs", "typescript", "frontend", "vue", "angular"],
    "react": ["javascript", "typescript", "frontend", "redux", "nextjs", "graphql"],
    "machine learning": ["python", "deep learning", "pytorch", "tensorflow", "data science", "mlops"],
    "deep learning": ["machine learning", "pytorch", "tensorflow", "nlp", "computer vision", "cuda"],
    "aws": ["devops", "cloud", "kubernetes", "docker", "terraform", "serverless"],
    "data science": ["python", "machine learning", "sql", "statistics", "pandas", "visualization"],
    "devops": ["kubernetes", "docker", "aws", "terraform", "ansible", "ci/cd", "linux"],
    "nlp": ["machine learning", "transformers", "bert", "llm", "text mining", "spacy"],
    "sql": ["data engineering", "data analyst", "postgresql", "etl", "dbt", "analytics"],
    "kubernetes": ["docker", "devops", "helm", "aws", "gcp", "service mesh", "cloud native"],
    "docker": ["kubernetes", "devops", "linux", "containerization", "microservices"],
    "typescript": ["javascript", "react", "nodejs", "frontend", "angular", "vue"],
    "data engineering": ["apache spark", "kafka", "airflow", "etl", "sql", "python", "cloud"],
    "llm": ["nlp", "python", "langchain", "rag", "prompt engineering", "fine-tuning"],
}

# --- A small example vocabulary for query parsing; callers pass their own ---
SKILLS = ["python", "java", "javascript", "react", "sql", "aws", "docker", "kubernetes", "machine learning", "deep learning", "data science", "devops", "nlp", "django", "typescript", "golang", "tensorflow", "pytorch"]
ROLES = ["software engineer", "data scientist", "data engineer", "product manager", "devops engineer", "python developer", "backend developer", "frontend developer", "data analyst"]
DOMAINS = {"fintech": ["banking", "payments"], "healthtech": ["healthcare", "medical"], "edtech": ["education", "elearning"], "ecommerce": ["retail", "marketplace"], "gaming": ["games"], "cybersecurity": ["infosec"]}
SKILL_ALIASES = {"kubernetes": ["k8s"], "javascript": ["js"], "python": ["py"], "machine learning": ["ml"], "aws": ["amazon web services"], "docker": ["containers"]}

# --- Fixed values: domains of entity fields ---
PROFICIENCY_LEVELS = ["beginner", "advanced beginner", "intermediate", "competent", "proficient", "expert"]
IMPORTANCE = ["high", "medium", "low"]
SKILL_TYPES = ["core", "secondary", "soft"]
SENIORITIES = ["intern", "trainee", "junior", "associate", "specialist", "consultant", "senior", "lead", "manager", "principal", "director", "executive", "chief"]

FUZZY_DISTANCE, FUZZY_RATIO, CANONICAL_RATIO, MOST_VARIANTS = 2, 0.70, 90, 10
