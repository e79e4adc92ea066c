"""clipwave.operators"""
