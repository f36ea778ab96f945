"""Set-based operators: profile, compare, sample, inject, detect, repair, score."""
