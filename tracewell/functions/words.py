"""Fixed word lists and patterns that results depend on."""

# Words that say nothing about a prompt.
STOP_WORDS = """
the a an is are was were be been being have has had do does did will would could should may might shall can need ought
to of in for on with at by from as into through during before after above below between out off over under again then
here there when where why how all each every both few more most other some such nor not only own same than too very
just because but and or if while about what which who whom this that these those it its my me we our you your he
she they them his her their up down no so
please help want like think know see look make take get let say tell give use find show try ask work call put keep also
file code change update add remove fix check run test new now still already done good right sure yeah yes okay thanks thank
""".split()

# The shorter list for keywords of ingested prompts.
INGEST_STOP_WORDS = """
the and for that this with from are was were been have has had but not you all can her his they will would could should
may might shall into also than then them these those what which who whom how when where why please thanks help need want like
make just let use try get take see look
""".split()

# Words of a prompt that only goes on with what was said before.
CONTINUATION_WORDS = """
yes yep yeah ok okay sure go do continue proceed agreed correct right exactly perfect awesome great good nice cool fine thanks
dude love both all apply ship send run sorry please ahead hell fuck damn shit make it them that this the lgtm sweet
keep going beautiful thorough just now
""".split()

# The words of each kind of task; of equal counts the first kind wins.
TASK_WORDS = {
    "refactor": ["refactor", "rename", "reorganize", "restructure", "cleanup", "simplify", "extract", "move"],
    "bug_fix": ["fix", "bug", "error", "broken", "crash", "issue", "wrong", "fail", "problem"],
    "feature": ["add", "implement", "create", "new", "feature", "build", "develop"],
    "review": ["review", "check", "look at", "examine", "audit", "analyze"],
    "exploration": ["find", "search", "where", "how does", "what is", "explain", "show", "explore"],
    "config": ["config", "setting", "environment", "setup", "install", "deploy"],
}

# The words that show an intent.
INTENT_WORDS = {
    "module_files": "add create implement build new introduce feature",
    "test_files": "tests? specs? assert coverage pytest jest unittest mock run\\stests",
    "refactor_targets": "refactor clean restructure reorganize simplify extract rename",
    "config_files": "config setting environment env deploy docker yaml toml",
    "perf_files": "performance slow optimize speed latency profile benchmark",
    "doc_files": "document readme docs explain describe comment changelog",
}

# Extensions of source files.
SOURCE_EXTENSIONS = ["py", "js", "ts", "tsx", "jsx", "go", "rs", "java", "c", "cpp", "rb"]
MENTION_EXTENSIONS = "py js ts tsx jsx go rs java c cpp h rb php swift kt md json yaml yml toml".split()
