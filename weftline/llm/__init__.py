"""Training-data operators. Nothing outside this subpackage imports it.

Each operator sits in a module of its own (``decontaminate``, ``toxicity``, ...);
``registry`` binds them to the driver tables as the ``opN_*`` queries.
"""
