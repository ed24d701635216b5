from .numeric import digamma, entropy_term, f_survival, half_open_bin, lerp, r6, safe_div

__all__ = ["digamma", "entropy_term", "f_survival", "half_open_bin", "lerp", "r6", "safe_div"]
