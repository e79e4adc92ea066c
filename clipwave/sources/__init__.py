"""clipwave.sources"""
