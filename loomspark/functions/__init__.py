"""loomspark.functions"""
