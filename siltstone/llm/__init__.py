"""Operations of a training-data pipeline: encoding, near-duplicates, quality, mixing.

Nothing outside this subpackage imports it, and it imports nothing of the
library outside it; ``llm.catalogue`` lists its queries and their SQL.
"""
