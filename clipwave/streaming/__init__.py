"""clipwave.streaming"""
