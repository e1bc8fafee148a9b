"""Training-data operators: tokenisation, token files, language-model scoring,
secret scans, quality rules, toxicity, HTML extraction, fingerprints, source
mixing and the n-gram Jaccard join. One module per operator; :mod:`queries`
registers them. Nothing else in the library imports this subpackage."""
