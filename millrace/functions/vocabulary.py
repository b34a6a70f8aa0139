"""Word lists, lookup tables and patterns that results depend on.

Nothing here is logic. Operators take these as default parameters.
"""

# Manufacturer -> owning group, for the used-car study.
BRAND_GROUPS = {
    "Mahindra-Renault": "Renault",
    "Land Rover": "Tata",
    "Jaguar": "Tata",
    "Lexus": "Toyota",
    "Porsche": "Volkswagen",
    "Bentley": "Volkswagen",
    "Audi": "Volkswagen",
    "Chevrolet": "Stellantis",
    "Datsun": "Nissan",
    "Jeep": "Stellantis",
    "Fiat": "Stellantis",
    "Kia": "Hyundai",
    "MINI": "BMW",
    "Skoda": "Volkswagen",
}

# Joint-venture manufacturer names.
MANUFACTURERS = {"Mahindra-Renault": "Renault"}

# Fuel labels.
FUEL_TYPES = {"Petrol + 1": "Petrol"}

# City -> market region.
CITY_REGIONS = {
    "Thane": "Mumbai",
    "Navi Mumbai": "Mumbai",
    "Pune": "Mumbai",
    "Agra": "Delhi",
    "Faridabad": "Delhi",
    "Ghaziabad": "Delhi",
    "Dehradun": "Delhi",
    "Lucknow": "Delhi",
    "Noida": "Delhi",
    "Panchkula": "Delhi",
}

# Luxury groups and makers. The source list misspells Porsche as
# "Porshe", so it never matches; the quirk list keeps that spelling.
LUXURY_GROUPS = ["BMW", "Mercedes-Benz"]
LUXURY_MAKERS = ["Land Rover", "Jaguar", "Audi", "Bentley", "Porsche", "Volvo", "Lamborghini"]
LUXURY_MAKERS_QUIRK = ["Land Rover", "Jaguar", "Audi", "Bentley", "Porshe", "Volvo", "Lamborghini"]

# Seven-point party code from (party answer, strength answer).
PARTY_BY_STRENGTH = {(2, 1): 7, (2, 2): 6, (1, 1): 1, (1, 2): 2}
# Seven-point party code from the leaning answer.
PARTY_BY_LEANING = {1: 5, 2: 4, -8: 4, -9: 4, 3: 3}
# Fixed value: the code for a missing answer.
MISSING_CODE = -9
# Seven-point codes of the two parties.
REPUBLICAN_CODES = [7, 6, 5]
DEMOCRAT_CODES = [1, 2, 3]

# Difficulty answers and the reasons that count as difficulty.
NO_DIFFICULTY_CODES = [1]
DIFFICULTY_CODES = [2, 3, 4, 5]
DIFFICULTY_REASONS = [6, 7, 8, 9, 10, 11, 12, 13, 14]

# Labels of the 2x2 experiment by (group, timing).
CELL_LABELS = {
    (0, 0): "Passive x No Timer",
    (0, 1): "Passive x Timer",
    (1, 0): "Active x No Timer",
    (1, 1): "Active x Timer",
}

# Operating systems by device class.
MOBILE_PATTERN = "Android|iP"
DESKTOP_PATTERN = "CrOS|Windows"
DESKTOP_NAMES = ["Linux x86_64", "Macintosh", "Ubuntu", "wv"]

# Degree levels in order.
DEGREE_LEVELS = [
    "High School",
    "Associate Degree",
    "Bachelors Degree",
    "Masters Degree",
    "Professional Degree",
    "PhD",
    "Technical Certifications",
]

# Story categories and their labels; others become the default.
CATEGORY_LABELS = {
    "foundational_model": "Foundational Model",
    "ai_tool": "AI Tool Launch",
    "research_paper": "Research Paper",
    "big_tech_move": "Big Tech Move",
    "funding": "Funding / M&A",
}
DEFAULT_CATEGORY = "big_tech_move"
REQUIRED_STORY_FIELDS = ["category", "headline", "source", "source_url", "summary", "relevance_notes"]

# Patterns of the first topic gate.
AI_TERMS = [
    r"a\.?\s*i\.?", "artificial intelligence",
    "machine learning", "deep learning", "neural network", "reinforcement learning",
    "large language model", "llm", "small language model", "slm",
    "generative ai", r"gen[\s-]?ai", "foundation model", "frontier model",
    "transformer", "diffusion model", "multimodal", "embedding model",
    "chatgpt", r"gpt[-\s]?\d", "claude", "gemini", "llama", "mistral", "grok", r"phi[-\s]?\d",
    "openai", "anthropic", "deepmind", r"hugging\s*face", r"stability\s*ai", "cohere",
    "copilot", "agentic", r"ai\s+agent",
    r"text[-\s]to[-\s](?:image|video|speech|3d)",
    "computer vision", "nlp", "natural language processing",
    r"nvidia\s+(?:h\d+|blackwell|hopper|b\d+)",
]

# Patterns of the second topic gate.
SCIENCE_TERMS = [
    "physics", "quantum", "relativity", r"particle\s+physics", "photon", "electron",
    "fusion", "fission", r"cosmolog\w*", r"astrophysic\w*", r"astronom\w*",
    "galaxy", "galaxies", r"black\s+hole", r"dark\s+(?:matter|energy)",
    r"gravitational\s+wave", "telescope",
    "nasa", "esa", "jaxa", "spacex", r"space\s+station", "rocket", "satellite",
    r"mars(?:\s+rover)?", "lunar", r"moon\s+mission", "asteroid", "exoplanet",
    "spacecraft", "orbital",
    "biology", "biotech", r"genom\w*", "crispr", "dna", "rna", "protein", "enzyme",
    "vaccine", r"antibod\w*", r"clinical\s+trial", r"fda\s+approval",
    r"drug\s+discovery", r"gene\s+therap\w*", r"stem\s+cell", "cancer",
    "alzheimer", "parkinson", "virus", r"bacteri\w*", r"microb\w*", "neuroscience",
    r"epidemiolog\w*", r"brain[-\s]computer",
    "chemistry", r"chemical\s+(?:reaction|engineering)", "catalyst", "polymer",
    "nanomaterial", "graphene", "battery", "superconductor",
    r"renewable\s+energy", r"solar\s+(?:cell|power)", r"wind\s+power",
    r"nuclear\s+(?:power|fusion|reactor)", r"hydrogen\s+fuel", "geothermal",
    r"climate\s+(?:change|model|science)", r"carbon\s+capture", r"emission\w*",
    "semiconductor", r"robotic\w*", r"robot\w*", r"autonomous\s+(?:vehicle|driving)",
    "drone", r"self[-\s]driving",
    r"mathematic\w*", "theorem", r"cryptograph\w*", r"algorithm\w*",
    r"quantum\s+comput\w*",
    r"scientif\w*", r"peer[-\s]reviewed", "preprint", "breakthrough", "discovery",
    "laboratory", r"researcher\w*",
    "mit", "stanford", "caltech", "harvard", "princeton", "berkeley", r"carnegie\s+mellon",
    "oxford", "cambridge", r"eth\s+zurich", r"nature\s+(?:medicine|physics|biotech\w*)",
    r"science\s+journal",
]

# Domains ranked by trust, most trusted kind first (primary
# research, academic, dedicated technology press, general press).
TRUST_TIERS = [
    ["anthropic.com", "openai.com", "deepmind.com", "deepmind.google", "research.google", "ai.meta.com",
     "microsoft.com", "machinelearning.apple.com", "huggingface.co", "nvidia.com", "aws.amazon.com"],
    ["arxiv.org", "ieee.org", "acm.org", "nature.com", "science.org", "spectrum.ieee.org", "mit.edu",
     "stanford.edu", "berkeley.edu", "cmu.edu", "oxford.ac.uk", "cambridge.ac.uk", "harvard.edu"],
    ["technologyreview.com", "thedecoder.com", "the-decoder.com", "venturebeat.com", "techcrunch.com",
     "theverge.com", "wired.com", "arstechnica.com", "marktechpost.com", "kdnuggets.com",
     "towardsdatascience.com", "latent.space", "scientificamerican.com", "quantamagazine.org", "sciencedaily.com"],
    ["nytimes.com", "bbc.co.uk", "npr.org", "theguardian.com", "cnn.com", "foxnews.com", "washingtonpost.com",
     "ft.com", "aljazeera.com", "cnbc.com", "reuters.com", "reutersagency.com"],
]

# English stop words.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out "
    "on off over under again further then once here there when where why how all any both each few more most "
    "other some such no nor not only own same so than too very s t can will just don should now"
).split()
