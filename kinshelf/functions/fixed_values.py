"""Lists and patterns that must stay as they are for equal results."""

TEXT_EXTENSIONS = ["txt", "md", "rst", "log"]
SUPPORTED_EXTENSIONS = ["txt", "md", "rst", "log", "pdf"]

# Extensions a label must not end with.
LABEL_EXTENSIONS = ["txt", "pdf", "md", "log", "docx", "xlsx"]

# Directory names whose events are not followed; the first is what packaging makes of this project.
EXCLUDED_DIRECTORIES = [
    "kinshelf.egg-info", "__pycache__", "node_modules", "venv", "env", ".git", ".idea", ".vscode",
    "dist", "build", ".pytest_cache", ".hypothesis",
]

# Characters a folder name must not contain.
FORBIDDEN_IN_FOLDER_NAME = r'[<>:"/\\|?*]'

# Words that never name a folder.
NAMING_IGNORE = """
page total source author date report file document untitled img image scanned text txt
pdf chapter section figure table example introduction conclusion reference references
abstract copyright rights reserved press published new use used using also one two may
like many well first second third however therefore thus hence etc http https www com org
key features include based main following type types common known called make makes large
small high low good best different world number part parts end way thing set run work
works working just get widely mainly typically generally often usually highly easily
simply really very quite strong basic basics simple modern powerful various several
specific certain particular provide provides support supports allow allows such given
able ability can could will need needs want take takes help helps
""".split()

# Spark's English stop words, as far as they are three or more plain letters.
STOP_WORDS = """
myself our ours ourselves you your yours yourself yourselves him his himself she her hers
herself its itself they them their theirs themselves what which who whom this that these
those are was were been being have has had having does did doing the and but because until
while for with about against between into through during before after above below from
down out off over under again further then once here there when where why how all any both
each few more most other some such nor not only own same than too very can will just don
should now cannot could ought would
""".split()

# Colours are handed out in turn over the sorted folders.
PALETTE_SIZE = 15
