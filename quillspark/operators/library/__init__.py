"""Photo-library analytics over metadata, model scores and review marks.

Only the relational shape of these operators is documented by what they stand in
for; thresholds, tie-breaks and blends are this engine's own parameters.
"""
