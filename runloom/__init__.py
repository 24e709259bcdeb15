"""Analytics over language-model workflow runs, prompts and test plans as Spark DataFrame operators."""

__version__ = "0.1.0"
