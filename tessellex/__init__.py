"""tessellex: technology-lexicon analytics expressed as PySpark DataFrame operators."""
