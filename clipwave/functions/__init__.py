"""clipwave.functions"""
